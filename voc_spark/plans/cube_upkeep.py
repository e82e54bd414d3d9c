"""The feedback cube kept up to date by signed delta cubes instead of being rebuilt.

The joined view splits by review_id: the rows of one review depend only on that review and its own classifications,
with or without dedupe="latest". So a batch changes the cube by
    cube(view of the touched ids after the batch) - cube(view of the touched ids before it),
where the touched ids are those of the batch's reviews and classifications. A relabelled review under "latest" gives -1 on
its old labels and +1 on the new ones; a first label of a pending review moves it out of the null row. The batch reads only
its own rows and the stored rows of its ids.

Layout below `root`:
  facts/reviews, facts/classifications   appended per batch, partitioned by id_bucket and batch. The batch's ids are
                                         joined on (id_bucket, review_id), so dynamic partition pruning opens only the
                                         buckets they hit, and `batch < k` prunes later batches.
  delta/batch=k                          the signed cube of batch k (n may be negative).
  base/upto=k                            all deltas up to k folded by `compact`.
Each step can be repeated: a batch's facts and delta are written by partition overwrite and the delta is computed from
earlier batches only, so a job that died at any point is rerun with the same batch number. `current` is the newest base
plus the later deltas, summed per cell, cells of 0 left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voc_spark.operators.counts import feedback_cube
from voc_spark.operators.ingest import first_per_key
from voc_spark.operators.joins import CLASS_COLUMNS, COUNT_KEYS, counting_view
from voc_spark.sources.parquet import drop_folder
from voc_spark import taxonomy as tx

#: Hash buckets of review ids in the stored facts: a batch opens only the buckets of its ids.
ID_BUCKETS = 64
CELL = [*tx.GROUP_COLUMNS, "review_day", "at_midnight"]


def id_bucket(key: str = "review_id"):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(ID_BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _batches(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{status.getPath()}/_SUCCESS")):
            found.append(int(name[len(prefix):]))
    return sorted(found)


def _facts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = f"{root}/facts/{name}"
    if _exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], f"{schema}, id_bucket int, batch long")


REVIEW_SCHEMA = "review_id string, product_category string, quarter string, verified_purchase boolean, review_date timestamp_ntz"
CLASS_SCHEMA = "review_id string, feedback_category string, sentiment string, urgency string, reasoning string, classified_at timestamp_ntz"


def signed_delta(old_reviews: DataFrame, old_classes: DataFrame, new_reviews: DataFrame, new_classes: DataFrame, dedupe: str | None = None) -> DataFrame:
    """The signed cube that the batch (new_*) adds to the cube of the stored rows (old_*); only touched ids are read."""
    touched = new_reviews.select("review_id", "id_bucket").unionByName(new_classes.select("review_id", "id_bucket")).where(
        "review_id IS NOT NULL").distinct()
    keys = ["id_bucket", "review_id"]
    before_r = old_reviews.join(touched, keys, "left_semi")
    before_c = old_classes.join(touched, keys, "left_semi")
    after_r = before_r.unionByName(new_reviews.select(*before_r.columns))
    after_c = before_c.unionByName(new_classes.select(*before_c.columns))
    # Joined rows stand for 1 after and for -1 before the batch, so that one cube, with one shuffle, is the difference.
    plus = counting_view(after_r, after_c, dedupe).withColumn("n", F.lit(1))
    minus = counting_view(before_r, before_c, dedupe).withColumn("n", F.lit(-1))
    return feedback_cube(plus.unionByName(minus)).where("n <> 0")


def apply_batch(spark: SparkSession, root: str, batch: int, reviews: DataFrame, classifications: DataFrame, dedupe: str | None = None) -> None:
    """Append one batch of reviews and classifications, and write its signed delta.

    Of a batch's rows with one new id the first by (review_date, verified_purchase, quarter, product_category) is kept, so a
    rerun keeps the same row; ids stored by an earlier batch are not inserted again.
    """
    old_r = _facts(spark, root, "reviews", REVIEW_SCHEMA).where(F.col("batch") < batch)
    old_c = _facts(spark, root, "classifications", CLASS_SCHEMA).where(F.col("batch") < batch)
    incoming = first_per_key(reviews.select(*COUNT_KEYS).where("review_id IS NOT NULL"), "review_id", COUNT_KEYS[1:][::-1])
    incoming = incoming.withColumn("id_bucket", id_bucket())
    fresh_r = incoming.join(old_r.select("id_bucket", "review_id"), ["id_bucket", "review_id"], "left_anti").withColumn("batch", F.lit(batch).cast("long"))
    fresh_c = classifications.select("review_id", *CLASS_COLUMNS).withColumn("id_bucket", id_bucket()).withColumn("batch", F.lit(batch).cast("long"))
    overwrite = {"partitionOverwriteMode": "dynamic"}
    _write_batch(spark, fresh_r, f"{root}/facts/reviews", overwrite)
    _write_batch(spark, fresh_c, f"{root}/facts/classifications", overwrite)
    batch_delta(spark, root, batch, dedupe).write.mode("overwrite").parquet(f"{root}/delta/batch={batch}")


def batch_delta(spark: SparkSession, root: str, batch: int, dedupe: str | None = None) -> DataFrame:
    """The signed cube of a batch whose facts are stored, from the stored facts of the batch and of those before it."""
    r = _facts(spark, root, "reviews", REVIEW_SCHEMA)
    c = _facts(spark, root, "classifications", CLASS_SCHEMA)
    old, new = F.col("batch") < batch, F.col("batch") == batch
    return signed_delta(r.where(old), c.where(old), r.where(new), c.where(new), dedupe)


def _write_batch(spark: SparkSession, rows: DataFrame, path: str, options: dict) -> None:
    # One task per bucket: a batch adds one file to each bucket it touches, not one per task.
    rows.repartition("id_bucket").write.mode("overwrite").options(**options).partitionBy("id_bucket", "batch").parquet(path)


def maintain(spark: SparkSession, root: str, reviews: DataFrame, classifications: DataFrame, arrival_reviews, arrival_classes,
             compact_every: int = 4, dedupe: str | None = None) -> DataFrame:
    """Feed both tables in batches by their arrival columns (one batch per distinct value, in order), compacting every
    `compact_every` batches; returns the cube as `current` reads it. The batch values are collected: they are periods."""
    tagged_r = reviews.withColumn("_arrival", arrival_reviews)
    tagged_c = classifications.withColumn("_arrival", arrival_classes)
    periods = sorted({r[0] for r in tagged_r.select("_arrival").union(tagged_c.select("_arrival")).distinct().collect()}, key=lambda v: (v is None, v))
    for k, period in enumerate(periods):
        pick = (lambda df: df.where(F.col("_arrival").isNull())) if period is None else (lambda df: df.where(F.col("_arrival") == period))
        apply_batch(spark, root, k, pick(tagged_r), pick(tagged_c), dedupe)
        if (k + 1) % compact_every == 0:
            compact(spark, root)
    return current(spark, root)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The cube now: newest base plus every later committed delta, summed per cell."""
    bases = _batches(spark, f"{root}/base", "upto=")
    upto = bases[-1] if bases else -1
    parts = [spark.read.parquet(f"{root}/base/upto={upto}")] if bases else []
    parts += [spark.read.parquet(f"{root}/delta/batch={k}") for k in _batches(spark, f"{root}/delta", "batch=") if k > upto]
    if not parts:
        return feedback_cube(counting_view(_facts(spark, root, "reviews", REVIEW_SCHEMA), _facts(spark, root, "classifications", CLASS_SCHEMA)))
    folded = parts[0].select(*CELL, "n")
    for p in parts[1:]:
        folded = folded.unionByName(p.select(*CELL, "n"))
    return folded.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def compact(spark: SparkSession, root: str) -> int:
    """Fold all committed deltas into a new base; older bases and folded deltas are deleted after it is committed."""
    deltas = _batches(spark, f"{root}/delta", "batch=")
    if not deltas:
        return -1
    upto = deltas[-1]
    current(spark, root).write.mode("overwrite").parquet(f"{root}/base/upto={upto}")
    for old in _batches(spark, f"{root}/base", "upto="):
        if old < upto:
            drop_folder(spark, f"{root}/base/upto={old}")
    for k in deltas:
        drop_folder(spark, f"{root}/delta/batch={k}")
    return upto
