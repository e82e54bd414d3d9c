"""Stored summaries for a whole table of date windows."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.times import plain_date
from voc_spark.operators.ingest import upsert_summaries
from voc_spark.operators.joins import counting_view
from voc_spark.operators.windows import date_range_overlap, stats_json, window_profiles, with_narrative
from voc_spark.sources.parquet import scratch, stored


def label_windows(windows: DataFrame) -> DataFrame:
    """Windows without a label of their own get the custom one."""
    custom = F.format_string(tx.SUMMARY_LABEL_FORMAT, "date_start", "date_end")
    given = F.col("window_label") if "window_label" in windows.columns else F.lit(None)
    return windows.withColumn("window_label", F.coalesce(given, custom))


def window_summaries(
    reviews: DataFrame, classifications: DataFrame, windows: DataFrame, end_of_day: bool = False,
    write_narratives=None, view: DataFrame | None = None,
) -> DataFrame:
    """One row per window: success, error, total_reviews, stats, narrative.

    `view` may bring the stored feedback cube in place of the joined tables.

    A window outside the data or without rows has an error and no stats. `write_narratives`
    may turn the profiles into (window_label, narrative) rows by a model. After the daily counts
    everything is computed on the window's own row.
    """
    profiles = window_profiles(counting_view(reviews, classifications) if view is None else view, windows, end_of_day)
    if write_narratives:
        profiles = stored(profiles, "profiles")
    done = with_narrative(profiles, write_narratives(profiles) if write_narratives else None)
    dated = F.col("date_start").isNotNull() & F.col("date_end").isNotNull()
    error = (
        F.when(~dated, "Both dates are needed.").when(~F.col("is_valid"), F.col("message"))
        .when(F.col("total_reviews") == 0, tx.NO_REVIEWS_IN_RANGE)
    )
    return date_range_overlap(done, reviews).withColumn("error", error).select(
        "window_label", "date_start", "date_end", F.col("error").isNull().alias("success"), "error",
        "total_reviews", stats_json().alias("stats"), "narrative",
    )


def run_summaries(
    spark: SparkSession, root: str, reviews: DataFrame, classifications: DataFrame, windows: DataFrame, view: DataFrame | None = None
) -> int:
    """Compute all windows and store the successful ones; returns the new version of the summaries table."""
    with scratch(spark):
        done = window_summaries(reviews, classifications, label_windows(windows), view=view).where("success")
        rows = done.select(
            "window_label", plain_date(F.col("date_start")).alias("date_start"),
            plain_date(F.col("date_end")).alias("date_end"), "total_reviews", "stats", "narrative",
        )
        return upsert_summaries(spark, root, rows)
