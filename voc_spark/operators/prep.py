"""Raw reviews to dated, keyed, banded rows. Everything here is a plain projection or filter."""

from pyspark.sql import Column, DataFrame, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.times import epoch_ms, epoch_ms_to_ts, ntz


def review_key(asin: str = "asin", user_id: str = "user_id") -> Column:
    """`asin_user`; null when either part is null."""
    return F.concat(F.col(asin).cast("string"), F.lit("_"), F.col(user_id).cast("string"))


def with_review_date(df: DataFrame) -> DataFrame:
    return df.withColumn("review_date", epoch_ms_to_ts(F.col("timestamp")))


def window_filter(df: DataFrame, start: str = tx.WINDOW_START, end: str = tx.WINDOW_END) -> DataFrame:
    """Rows from start to end, both included; a plain end date means its midnight.

    The bounds are compared with the stored epoch column, so they reach the Parquet scan.
    """
    return df.where(F.col("timestamp").between(epoch_ms(start), epoch_ms(end)))


def quarter_label(
    ts: Column, q1_end: str = tx.Q1_END, first: str = tx.Q1_LABEL, second: str = tx.Q2_LABEL
) -> Column:
    """`first` up to the midnight of `q1_end`, else `second` (also for the rest of that day)."""
    return F.when(ts <= ntz(q1_end), first).otherwise(second)


def rating_band(rating: Column) -> Column:
    """low (2 or less), mid (exactly 3), high (4 or more); null in between."""
    return F.when(rating <= 2, "low").when(rating == 3, "mid").when(rating >= 4, "high")


def windowed_reviews(
    raw: DataFrame, start: str = tx.WINDOW_START, end: str = tx.WINDOW_END, q1_end: str = tx.Q1_END,
    labels: tuple[str, str] = (tx.Q1_LABEL, tx.Q2_LABEL),
) -> DataFrame:
    """Raw reviews inside the window, with review_date and quarter."""
    dated = with_review_date(window_filter(raw, start, end))
    return dated.withColumn("quarter", quarter_label(F.col("review_date"), q1_end, *labels))
