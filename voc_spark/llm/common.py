"""Helpers shared by the operators: column selection, words, let-bindings, folds and the stored scratch tables."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voc_spark.sources.parquet import drop_folder

#: ASCII blanks only: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For steps whose result is stored: shuffle files go as soon as the step ends, and Python gets batches of 8 MB, not 64.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """What runs inside the block runs with LEAN; the session's own settings come back at its end."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


#: Stored tables hold overlapping contexts and rising ids, which pack well.
PACKED = {"compression": "zstd"}


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark's cleaner drop the shuffle files of finished steps."""
    for path in (p for t in tables for p in t.inputFiles()[:1]):
        drop_folder(spark, path.rsplit("/", 1)[0])
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with these types; other columns, whatever they are called, are left behind."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in types.items()])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows never used for fitting; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def carry(*names: str) -> None:
    """Functions of these modules travel inside the task itself, so executors need no copy of the package."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, seed: int = 7) -> list[tuple[str, int]]:
    """At most `rows` labelled texts outside the held-out fold, chosen by a hash of the id, for fitting on the driver.

    Both bounds are parameters: texts longer than `max_chars` are not chosen for fitting (they
    are scored like any other). Ids that occur more than once count once, with their smallest label.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    chosen = usable.orderBy(key, "doc_id").limit(rows)
    texts = pick(docs, doc_id="long", text="string").where(F.length("text") <= max_chars)
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return [(r.text, r.label) for r in got.orderBy("doc_id").collect()]
