"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a schedule of that weight over training time 0 to 1. The integral of its schedule,
times its target words, is its cumulative demand; a document that covers words c to c + n of its source's stream is
trained on when the demand reaches the middle of that span. Documents are then range-sorted by that position.

A source's stream is its documents in the order of a hash of the id, passed over up to twice. Running word counts in
that order come from sums per (source, hash range) plus a window inside each range, so a source that holds most rows is
spread over many tasks.

Null texts and texts of blanks have size 0 and are never taken; null is a source of its own, ranked last. Repeated rows
are separate documents. An empty table gives an empty mix. Other columns of the input are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc_spark.llm.common import WORD
from voc_spark.sources.parquet import stored

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds, and how often a source may be passed over.
SHARE, MOST_PASSES = 1.5, 2
#: Knots (time, multiple of the weight) per weight: heavy sources fade out, light ones come in. Each has mean 1.
SCHEDULES: dict[int, Sequence[tuple[float, float]]] = {
    5: ((0.0, 1.25), (0.5, 1.25), (1.0, 0.25)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    1: ((0.0, 0.25), (0.5, 1.25), (1.0, 1.25)),
}
RANGE_ROWS = 1024


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def hash_key(doc_id: str = "doc_id") -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size, weight, target from (source, source_size); one row per source, so one small window.

    Sorted by cap over weight, the first source that its proportional share does not fill fixes the common level;
    all before it stop at their cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(passes)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(everything) - before) / rest
    filled = ranked.withColumn("level", level)
    common = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return filled.withColumn("common", common).select(
        "source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("common") * F.col("weight")), F.col("cap")).alias("target"))


def when_reached(part: Column, weight: Column, schedules: dict[int, Sequence[tuple[float, float]]]) -> Column:
    """Time at which the demand of a source with this weight has reached `part` (0 to 1) of its target."""
    answer = part
    for w, knots in schedules.items():
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:])]
        whole, done, time = sum(areas), 0.0, F.lit(float(knots[-1][0]))
        pieces = []
        for ((t0, a), (t1, b)), area in zip(zip(knots, knots[1:]), areas):
            u, slope = part * whole - done, (b - a) / (t1 - t0)
            step = u / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * u, F.lit(0.0))) - a) / slope
            done += area
            pieces.append((part * whole <= done, F.lit(t0) + step))
        for inside, value in reversed(pieces):
            time = F.when(inside, value).otherwise(time)
        answer = F.when(weight == w, F.least(time, F.lit(float(knots[-1][0])))).otherwise(answer)
    return answer


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: dict[int, Sequence[tuple[float, float]]] = SCHEDULES,
        share: float = SHARE, passes: int = MOST_PASSES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`docs` (doc_id, source, size and any other columns) plus source_size, target, taken and copies, range-sorted by first position.

    `copies` has (words, position) of each time the document is trained on. The document at which a source's
    target runs out is taken up to the word that fills it, so the words taken equal the rounded target.
    """
    own = docs.columns
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / range_rows)))
    bucket = F.shiftright(F.conv(F.substring("_h", 1, 12), 16, 10).cast("long"), max(0, 48 - bits))
    keyed = docs.withColumn("_h", hash_key()).withColumn("_bucket", bucket)
    sums = stored(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, passes)
    goal = goal.select(F.col("source").alias("_s"), "source_size", "weight", "target")
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    offsets = offsets.join(goal.withColumnRenamed("_s", "_g"), F.col("_s").eqNullSafe(F.col("_g"))).drop("_g")
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["_s"]) & (placed["_bucket"] == offsets["_b"]))
    start, wanted = F.col("_offset") + F.col("_inside"), F.round("target").cast("long")
    copies = []
    for p in range(passes):
        at = start + p * F.col("source_size")
        n = F.greatest(F.least(wanted - at, F.col("size")), F.lit(0))
        part = F.least((at + n / 2) / F.greatest(wanted, F.lit(1)), F.lit(1.0))
        copies.append(F.struct(n.alias("words"), when_reached(part, F.col("weight"), schedules).alias("position")))
    placed = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    placed = placed.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    placed = placed.select(*own, "source_size", "target", "taken", "copies", F.get(F.col("copies"), F.lit(0))["position"].alias("position"))
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
