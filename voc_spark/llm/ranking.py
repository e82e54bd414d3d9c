"""Ranks 1, 2, 3, ... over a whole table from one distributed sort, with no single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc_spark.sources.parquet import stored

_ROW_BITS = 33  # monotonically_increasing_id: partition index above, row within the partition below


def global_rank(df: DataFrame, keys: list[Column], eligible: Column, percent: int) -> DataFrame:
    """df with `rank`: the place in `keys` order among eligible rows, kept for the first floor(percent * N / 100) of the N.

    The eligible rows are range-sorted by Spark and numbered within each sorted partition; the offsets of the partitions
    (one row each, so bounded by the number of partitions) are summed on the driver and joined back. Other rows get null.
    """
    marked = stored(df.withColumn("_eligible", F.coalesce(eligible, F.lit(False))), "rank-input")
    n = marked.where("_eligible").count()
    drawn = percent * n // 100
    ordered = stored(marked.where("_eligible").orderBy(*keys).withColumn("_mono", F.monotonically_increasing_id()), "rank-sorted")
    sizes = ordered.groupBy(F.shiftright("_mono", _ROW_BITS).alias("_part")).count().orderBy("_part").collect()
    offsets, before = [], 0
    for r in sizes:
        offsets.append((r["_part"], before))
        before += r["count"]
    spark = df.sparkSession
    offset_table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _offset long")
    place = F.col("_offset") + F.col("_mono").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    ranked = ordered.join(F.broadcast(offset_table), F.shiftright("_mono", _ROW_BITS) == F.col("_part")).withColumn(
        "rank", F.when(place <= drawn, place))
    rest = marked.where("NOT _eligible").withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("_part", "_offset", "_mono", "_eligible").unionByName(rest.drop("_eligible"))
