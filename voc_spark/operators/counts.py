"""Counts of joined rows: one number, breakdowns, marginals, themes, the stored cube.

Input is any frame with the group columns. A column `n`, as in the stored cube, holds the
joined rows that a row stands for; without it each row counts once.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.times import is_midnight
from voc_spark.operators.filters import filter_dates, filter_dimensions, filter_verified


def rows_in(df: DataFrame) -> Column:
    """Aggregate that counts joined rows."""
    return F.coalesce(F.sum("n"), F.lit(0)) if "n" in df.columns else F.count(F.lit(1))


def group_column(name: str, message: str) -> str:
    """The whitelisted group column, else ValueError with the user-facing message."""
    if name not in tx.GROUP_COLUMNS:
        raise ValueError(message % name)
    return name


def _filters(spec: dict) -> dict:
    return {d: spec.get(d) for d in tx.FILTER_DIMENSIONS}


def count_query(view: DataFrame, **spec) -> DataFrame:
    """One row `count`: joined rows under dimension, verified and date filters."""
    df = filter_verified(filter_dimensions(view, **_filters(spec)), spec.get("verified_purchase"))
    df = filter_dates(df, spec.get("date_start"), spec.get("date_end"), spec.get("end_of_day", False))
    return df.agg(rows_in(df).alias("count"))


def _grouped(df: DataFrame, column: str) -> DataFrame:
    counted = df.groupBy(column).agg(rows_in(df).alias("count"))
    shown = counted.select(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias(column), "count")
    return shown.orderBy(F.desc("count"), column)


def breakdown_query(view: DataFrame, column: str, strict: bool = False, **spec) -> DataFrame:
    """Count per value of one column, most frequent first, null shown as 'null'.

    Date and verified filters are left out unless `strict`.
    """
    column = group_column(column, tx.BAD_BREAKDOWN_FORMAT)
    df = filter_dimensions(view, **_filters(spec))
    if strict:
        df = filter_verified(df, spec.get("verified_purchase"))
        df = filter_dates(df, spec.get("date_start"), spec.get("date_end"))
    return _grouped(df, column)


def chart_query(view: DataFrame, column: str, strict: bool = False, **spec) -> DataFrame:
    """As the breakdown, with the date filter applied and the verified filter left out unless `strict`."""
    column = group_column(column, tx.BAD_CHART_FORMAT)
    df = filter_dates(filter_dimensions(view, **_filters(spec)), spec.get("date_start"), spec.get("date_end"))
    if strict:
        df = filter_verified(df, spec.get("verified_purchase"))
    return _grouped(df, column)


def marginal_counts(
    df: DataFrame, keys: Sequence[str] = (), dims: Sequence[str] = tuple(tx.FILTER_DIMENSIONS), total: bool = True
) -> DataFrame:
    """(keys…, dimension, value, count): one count per value of each dimension, nulls dropped, plus the total.

    The rows are first counted per combination of all dimensions, map-side combined, and
    only that small result is spread over the dimensions.
    """
    combos = df.groupBy(*keys, *dims).agg(rows_in(df).alias("c"))
    entry = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    entries = [entry(d, F.col(d).cast("string")) for d in dims] + ([entry("total", F.lit("all"))] if total else [])
    spread = combos.select(*keys, "c", F.inline(F.array(*entries))).where("value IS NOT NULL")
    if total and not keys:
        # Keeps the total when no row is left.
        none = df.sparkSession.range(1).select(
            F.lit(0).cast("bigint").alias("c"), F.lit("total").alias("dimension"), F.lit("all").alias("value")
        )
        spread = spread.unionByName(none)
    return spread.groupBy(*keys, "dimension", "value").agg(F.sum("c").alias("count"))


def aggregated_stats(view: DataFrame, **filters: str | None) -> DataFrame:
    """Total and four marginals of the joined rows that pass the filters.

    All rows count. For statistics of the newest rows only, pass `joins.latest_reviews(…, limit)` as the view.
    """
    return marginal_counts(filter_dimensions(view, **filters))


def filtered_rows(joined: DataFrame, **filters: str | None) -> DataFrame:
    """The joined rows behind `aggregated_stats`, all columns, for drilling down."""
    return filter_dimensions(joined, **filters)


def top_themes(view: DataFrame, n: int = 5, **filters: str | None) -> DataFrame:
    """The `n` most frequent feedback categories of the filtered rows."""
    df = filter_dimensions(view, **filters).where(F.col("feedback_category").isNotNull())
    counted = df.groupBy("feedback_category").agg(rows_in(df).alias("count"))
    return counted.orderBy(F.desc("count"), "feedback_category").limit(n)


def window_stats(view: DataFrame, date_start: str, date_end: str, end_of_day: bool = False) -> DataFrame:
    """Total and four marginals of one date window over the whole table."""
    return marginal_counts(filter_dates(view, date_start, date_end, end_of_day))


def dashboard_charts(selected: DataFrame) -> DataFrame:
    """Four count series and the banner as (dimension, position, value, count).

    Bars come by count, except urgency, whose axis is fixed.
    """
    counts = marginal_counts(selected)
    axis = F.array_position(F.array(*map(F.lit, tx.URGENCY_AXIS)), F.col("value")).cast("int")
    by_count = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("count"), "value"))
    is_total = F.col("dimension") == "total"
    return counts.withColumn("r", by_count).select(
        F.when(is_total, "banner").otherwise(F.col("dimension")).alias("dimension"),
        F.when(is_total, 0).when(F.col("dimension") == "urgency", axis).otherwise(F.col("r")).alias("position"),
        F.when(is_total, F.format_string(tx.BANNER_FORMAT, "count")).otherwise(F.col("value")).alias("value"),
        "count",
    )


def feedback_cube(view: DataFrame) -> DataFrame:
    """Counts per group columns and review day, to be stored once and asked often.

    `at_midnight` keeps apart the rows that an end date still includes, so whole-day
    windows give the same counts as the rows themselves.
    """
    date = F.col("review_date")
    return (
        view.withColumns({"review_day": date.cast("date"), "at_midnight": F.coalesce(is_midnight(date), F.lit(False))})
        .groupBy(*tx.GROUP_COLUMNS, "review_day", "at_midnight").agg(rows_in(view).alias("n"))
    )
