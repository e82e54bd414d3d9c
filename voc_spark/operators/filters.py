"""Optional filters; a missing or empty value means no filter."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voc_spark.functions.times import is_plain_date, ntz
from voc_spark.taxonomy import BAD_DATES_FORMAT, FILTER_DIMENSIONS


def filter_dimensions(
    df: DataFrame, product_category: str | None = None, feedback_category: str | None = None,
    sentiment: str | None = None, urgency: str | None = None,
) -> DataFrame:
    """AND of the equalities that are given."""
    wanted = dict(zip(FILTER_DIMENSIONS, (product_category, feedback_category, sentiment, urgency)))
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def filter_verified(df: DataFrame, verified_purchase: bool | None = None) -> DataFrame:
    """False is a filter of its own; only None means all."""
    return df if verified_purchase is None else df.where(F.col("verified_purchase") == verified_purchase)


def filter_dates(
    df: DataFrame, date_start: str | None = None, date_end: str | None = None, end_of_day: bool = False
) -> DataFrame:
    """Both ends included, and only if both are given.

    The end date means its midnight; `end_of_day` takes in the whole day. Works on
    review_date, or on the (review_day, at_midnight) pair of the feedback cube. Anything but
    a plain date raises ValueError, as tables of specs and windows answer it with an error.
    """
    if not (date_start and date_end):
        return df
    if not (is_plain_date(date_start) and is_plain_date(date_end)):
        raise ValueError(BAD_DATES_FORMAT % (date_start, date_end))
    if "review_date" in df.columns:
        date = F.col("review_date")
        if end_of_day:
            return df.where((date >= ntz(date_start)) & (date < F.timestamp_add("DAY", F.lit(1), ntz(date_end))))
        return df.where(date.between(ntz(date_start), ntz(date_end)))
    start, end, day = F.lit(date_start).cast("date"), F.lit(date_end).cast("date"), F.col("review_day")
    last = F.lit(True) if end_of_day else (day < end) | F.col("at_midnight")
    return df.where(day.between(start, end) & last)


def filter_multi_select(df: DataFrame, **chosen: Sequence[str] | None) -> DataFrame:
    """OR inside a dimension, AND across dimensions; an empty list means all."""
    for name, values in chosen.items():
        if name not in FILTER_DIMENSIONS:
            raise ValueError(f"no such dimension: {name}")
        if values:
            df = df.where(F.col(name).isin(list(values)))
    return df
