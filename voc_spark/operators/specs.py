"""Query specs as rows: checked, normalised and answered many at a time."""

from collections.abc import Sequence
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from voc_spark import taxonomy as tx
from voc_spark.functions.times import bad_dates, is_midnight, ntz, plain_date
from voc_spark.operators.counts import rows_in
from voc_spark.operators.profile import coverage
from voc_spark.schemas import QUERY_SPECS
from voc_spark.sources.parquet import stored

SPEC_FILTERS = [*tx.FILTER_DIMENSIONS, "verified_purchase"]


def spec_table(spark: SparkSession, specs: Sequence[dict]) -> DataFrame:
    """Spec dicts as rows; spec_id is the position where none is given."""
    schema = T.StructType([T.StructField("spec_id", T.LongType(), False), *QUERY_SPECS.fields])
    rows = [[s.get("spec_id", i), *[s.get(f) for f in QUERY_SPECS.fieldNames()]] for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, schema)


def normalize_specs(specs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Put reversed dates in order, clip to the covered dates, reject ranges without data; each change is noted."""
    cover = coverage(reviews).select(
        F.struct(F.col("date_min").cast("date").alias("lo"), F.col("date_max").cast("date").alias("hi")).alias("c")
    ).scalar()
    first, second = plain_date(F.col("date_start")), plain_date(F.col("date_end"))
    both = first.isNotNull() & second.isNotNull()
    dated = specs.withColumn("c", cover).withColumns({"s": F.least(first, second), "e": F.greatest(first, second)})
    lo, hi, s, e = F.col("c.lo"), F.col("c.hi"), F.col("s"), F.col("e")
    outside = both & F.coalesce((e < lo) | (s > hi), F.lit(True))
    clipped = both & ~outside & ((s < lo) | (e > hi))
    start, end = F.when(outside, s).otherwise(F.greatest(s, lo)), F.when(outside, e).otherwise(F.least(e, hi))
    text = lambda d: d.cast("string")
    notes = [
        F.when(both & (first > second), F.concat(F.lit("Dates reordered to "), text(s), F.lit(" to "), text(e), F.lit("."))),
        F.when(outside, F.format_string(tx.OUT_OF_RANGE_FORMAT, F.coalesce(text(lo), F.lit("none")), F.coalesce(text(hi), F.lit("none")))),
        F.when(clipped, F.concat(F.lit("Range clipped to "), text(start), F.lit(" to "), text(end), F.lit("."))),
    ]
    return dated.select(
        *[c for c in specs.columns if c not in ("query_type", "date_start", "date_end", "explanation")],
        F.when(outside, "unsupported").otherwise(F.col("query_type")).alias("query_type"),
        F.when(both, text(start)).otherwise(F.col("date_start")).alias("date_start"),
        F.when(both, text(end)).otherwise(F.col("date_end")).alias("date_end"),
        F.concat_ws(" ", "explanation", *notes).alias("explanation"),
    )


def validate_specs(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(spec_id, problem): unknown query types, filter values that occur nowhere in the data, columns outside the whitelist."""
    # Stored, so that its size is known: it is broadcast while small, and the specs are then read once and not shuffled.
    values = stored(known.where("value IS NOT NULL").select(F.col("column"), F.col("value")), "known")

    def bad_column(query_type: str, name: str, message: str) -> Column:
        bad = (F.col("query_type") == query_type) & ~F.coalesce(F.col(name).isin(tx.GROUP_COLUMNS), F.lit(False))
        return F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"),
                        F.when(bad, F.format_string(message, F.coalesce(F.col(name), F.lit("None")))).alias("problem"))

    bad_type = ~F.coalesce(F.col("query_type").isin(tx.QUERY_TYPES), F.lit(False))
    checks = [
        F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"),
                 F.when(bad_type, F.concat(F.lit("unknown query type "), F.coalesce("query_type", F.lit("None")))).alias("problem")),
        bad_column("breakdown", "breakdown_column", tx.BAD_BREAKDOWN_FORMAT), bad_column("chart", "group_by_column", tx.BAD_CHART_FORMAT),
        *[F.struct(F.lit(d).alias("column"), F.col(d).alias("value"), F.concat(F.lit(d + ": unknown value "), F.col(d)).alias("problem")) for d in tx.FILTER_DIMENSIONS],
    ]
    rows = specs.select("spec_id", F.inline(F.array(*checks))).where("problem IS NOT NULL AND coalesce(value, ' ') <> ''")
    return rows.join(values, ["column", "value"], "left_anti").select("spec_id", "problem")


def chart_types(requested: Column) -> Column:
    """Known types only, bar by default; with a line among them, lines become bars and repeats go."""
    known = F.filter(F.coalesce(requested, F.array().cast("array<string>")), lambda t: t.isin(tx.CHART_TYPES))
    types = F.when(F.size(known) == 0, F.array(F.lit("bar"))).otherwise(known)
    as_bars = F.array_distinct(F.transform(types, lambda t: F.when(t == "line", "bar").otherwise(t)))
    return F.when(F.array_contains(types, "line"), as_bars).otherwise(types)


def chart_note(requested: Column) -> Column:
    """The note shown when a line chart was asked for, else null."""
    return F.when(F.coalesce(F.array_contains(requested, "line"), F.lit(False)), tx.LINE_NOTE)


def normalize_chart_types(specs: DataFrame) -> DataFrame:
    return specs.withColumns({"chart_types": chart_types(F.col("chart_types")), "note": chart_note(F.col("chart_types"))})


def count_spec_list(view: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """(spec_id, count) of a short list of specs, all answered by one pass over the view."""
    weight = F.col("n") if "n" in view.columns else F.lit(1)
    counts = []
    for i, spec in enumerate(specs):
        keep = F.lit(True)
        for d in tx.FILTER_DIMENSIONS:
            if spec.get(d):
                keep &= F.coalesce(F.col(d) == spec[d], F.lit(False))
        if spec.get("verified_purchase") is not None:
            keep &= F.coalesce(F.col("verified_purchase") == spec["verified_purchase"], F.lit(False))
        if spec.get("date_start") and spec.get("date_end"):
            inside = F.col("review_date").between(ntz(spec["date_start"]), ntz(spec["date_end"]))
            keep &= F.coalesce(inside, F.lit(False))
        counts.append(F.coalesce(F.sum(F.when(keep, weight)), F.lit(0)).cast("bigint").alias(f"c{i}"))
    return view.agg(*counts).select(F.inline(F.array(*[
        F.struct(F.lit(spec["spec_id"]).cast("bigint").alias("spec_id"), F.col(f"c{i}").alias("count"))
        for i, spec in enumerate(specs)
    ])))


def _pattern(columns: Sequence[str]) -> Column:
    """Which filters are absent, as bits; the first column is the highest bit, as in grouping_id."""
    bit = lambda i, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1 << (len(columns) - 1 - i)).otherwise(0)
    total = F.lit(0)
    for i, c in enumerate(columns):
        total = total + bit(i, c)
    return total.cast("bigint")


def _keys(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{i}") for i, c in enumerate(columns)]


def count_specs(view: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, count, error) of a spec table of any size, by equi-joins on pre-counted rows.

    A spec with dates that are not plain dates gets an error and the count 0. The view, or the stored feedback cube, is counted per combination of the filter columns, and that small result per
    subset of them (grouping sets). An absent filter then is part of the join key: the pattern of
    absent filters and the given values. A dated spec is the difference of two running sums
    over daily counts, so the length of its range costs nothing.
    """
    keys = ["pattern", *[f"k{i}" for i in range(len(SPEC_FILTERS))]]
    signed = specs.select(
        "spec_id", _pattern(SPEC_FILTERS).alias("pattern"), *_keys(SPEC_FILTERS),
        plain_date(F.col("date_start")).alias("s"), plain_date(F.col("date_end")).alias("e"), bad_dates(F.col("date_start"), F.col("date_end")).alias("bad"),
        F.format_string(tx.BAD_DATES_FORMAT, "date_start", "date_end").alias("problem"),
    )
    rejected = signed.where("bad").select("spec_id", F.lit(0).cast("bigint").alias("count"), F.col("problem").alias("error"))
    signed = signed.where("NOT bad")
    is_dated = F.col("s").isNotNull() & F.col("e").isNotNull()
    days = view.withColumnRenamed("review_day", "day") if "review_day" in view.columns else view.withColumns(
        {"day": F.col("review_date").cast("date"), "at_midnight": is_midnight(F.col("review_date"))}
    )
    daily = days.groupBy(*SPEC_FILTERS, "day", "at_midnight").agg(rows_in(view).alias("c"))
    daily = stored(daily, "daily")

    whole = daily.groupBy(*SPEC_FILTERS).agg(F.sum("c").alias("c")).cube(*SPEC_FILTERS).agg(
        F.grouping_id().alias("pattern"), F.sum("c").alias("count")
    ).select("pattern", *_keys(SPEC_FILTERS), "count")
    whole = stored(whole, "whole")  # with a size, so it is broadcast when small and few patterns don't gather all specs
    undated = signed.where(~is_dated).join(whole, keys, "left").select("spec_id", F.coalesce("count", F.lit(0)).alias("count"))

    # Order of events within a day: start edge, midnight rows, end edge, later rows.
    subsets = chain.from_iterable(combinations(SPEC_FILTERS, r) for r in range(len(SPEC_FILTERS) + 1))
    by_day = daily.where("day IS NOT NULL").groupingSets(
        [[*sub, "day", "at_midnight"] for sub in subsets], *SPEC_FILTERS, "day", "at_midnight"
    ).agg(F.grouping_id().alias("gid"), F.sum("c").alias("c")).select(
        F.shiftright("gid", 2).alias("pattern"), *_keys(SPEC_FILTERS), "day",
        F.when(F.col("at_midnight"), 1).otherwise(3).alias("step"), "c",
    )
    dated = signed.where(is_dated & (F.col("s") <= F.col("e"))).select(
        "spec_id", *keys, F.inline(F.array(
            F.struct(F.col("s").alias("day"), F.lit(0).alias("step")), F.struct(F.col("e").alias("day"), F.lit(2).alias("step"))
        ))
    )
    # Distinct edges: a series holds at most two per calendar day, however many specs ask for it.
    edges = stored(dated.select(*keys, "day", "step").distinct(), "edges")
    asked = stored(edges.select(*keys).distinct(), "asked")
    wanted = by_day.join(asked, keys, "left_semi")
    series = Window.partitionBy(*keys).orderBy("day", "step").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        wanted.unionByName(edges.withColumn("c", F.lit(0).cast("bigint")))
        .withColumn("upto", F.sum("c").over(series)).where("step IN (0, 2)").drop("c")
    )
    ranged = dated.join(running, [*keys, "day", "step"]).groupBy("spec_id").agg(
        F.sum(F.when(F.col("step") == 2, F.col("upto")).otherwise(-F.col("upto"))).alias("count")
    )
    reversed_dates = signed.where(is_dated & (F.col("s") > F.col("e"))).select("spec_id", F.lit(0).cast("bigint").alias("count"))
    counted = undated.unionByName(ranged).unionByName(reversed_dates)
    return counted.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)
