"""Live coverage, distinct values, schema profile and table preview."""

from pyspark.sql import DataFrame, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.literal import literal_table

REVIEW_FACETS = ["product_category", "quarter"]
CLASS_FACETS = ["feedback_category", "sentiment", "urgency"]
PREVIEW_TABLES = ["reviews", "classifications"]


def coverage(reviews: DataFrame) -> DataFrame:
    """One row: review count, first and last review date."""
    return reviews.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("review_date").alias("date_min"), F.max("review_date").alias("date_max")
    )


def _facets(df: DataFrame, names: list[str]) -> DataFrame:
    # Distinct combinations first: few rows are left to spread over the columns.
    combos = df.select(*names).distinct()
    return combos.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names
    ]))).distinct()


def distinct_values(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    """(column, value) for the five categorical columns, one aggregate per table."""
    return _facets(reviews, REVIEW_FACETS).unionByName(_facets(classifications, CLASS_FACETS))


def schema_profile(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    """One row per column and possible value: position, type, range, note, with the row count of the table.

    Columns without listed values give one row with a null value.
    """
    spark = reviews.sparkSession
    cover = coverage(reviews).select(F.struct("row_count", "date_min", "date_max").alias("c")).scalar()
    static = literal_table(
        spark, {"position": "int", "column": "string", "type": "string", "range": "string", "note": "string"},
        [(i, *c) for i, c in enumerate(tx.PROFILE_COLUMNS)],
    ).withColumn("c", cover)
    flags = literal_table(
        spark, {"column": "string", "value": "string"}, [("verified_purchase", "true"), ("verified_purchase", "false")]
    )
    values = distinct_values(reviews, classifications).unionByName(flags)
    live = F.concat_ws(" to ", F.col("c.date_min").cast("string"), F.col("c.date_max").cast("string"))
    return static.join(values, "column", "left").select(
        "position", "column", "type",
        F.when(F.col("range") == "data", live).otherwise(F.col("range")).alias("range"),
        "note", "value", F.col("c.row_count").alias("row_count"),
    )


def table_preview(table: DataFrame, name: str, limit: int = 50, width: int | None = None, order: str | None = None) -> DataFrame:
    """The first rows of a whitelisted table; `width` cuts each cell, shown as text."""
    if name not in PREVIEW_TABLES:
        raise ValueError(f"Table '{name}' is not accessible. Allowed: {PREVIEW_TABLES}")
    rows = (table.orderBy(order) if order else table).limit(limit)
    if width is None:
        return rows
    return rows.select(*[F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in rows.columns])
