"""The batch jobs that write: reviews into their table, labels for what has none yet."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from voc_spark.operators.ingest import insert_if_absent, insert_report, stamp_classified, stamp_ingested
from voc_spark.operators.joins import pending_reviews
from voc_spark.schemas import CLASSIFICATIONS, REVIEWS
from voc_spark.sources.parquet import ID_LOOKUP, scratch, stored


def ingest_reviews(
    spark: SparkSession, path: str, incoming: DataFrame, order: Sequence[str] = ("review_date",)
) -> DataFrame:
    """Append the reviews whose key is new; returns (attempted, inserted, skipped). A rerun appends none."""
    with scratch(spark):
        # Both sides of the report are what was stored: the input may change meanwhile, the counts still add up.
        tried = stored(incoming, "incoming")
        fresh = stored(insert_if_absent(tried, spark.read.schema(REVIEWS).parquet(path), order=order), "fresh")
        stamp_ingested(fresh).sortWithinPartitions("review_date").write.mode("append").options(**ID_LOOKUP).parquet(path)
        report = insert_report(tried, fresh).first()
    return spark.createDataFrame([tuple(report)], "attempted long, inserted long, skipped long")


def classify_pending(
    spark: SparkSession, reviews_path: str, labels_path: str, classify: Callable[[DataFrame], DataFrame]
) -> None:
    """Label every stored review that has no label yet and append the results.

    `classify` adds the four label columns, as the rule and model classifiers do. A job that
    dies before its commit leaves nothing behind, so running it again is enough.
    """
    labels = spark.read.schema(CLASSIFICATIONS).parquet(labels_path)
    # Written first: the labels table must not be read while it is appended to.
    with scratch(spark):
        done = stored(
            stamp_classified(classify(pending_reviews(spark.read.schema(REVIEWS).parquet(reviews_path), labels))), "labels"
        )
        done.write.mode("append").options(**ID_LOOKUP).parquet(labels_path)
