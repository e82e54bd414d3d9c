"""Reviews joined with their classifications.

`reviews` has one row per review_id; `classifications` may hold any number per review,
so a single review may own a large share of that table. Each join below keeps such a
group splittable or folds it before the shuffle.
"""

from pyspark.sql import DataFrame, functions as F


LABELS = ["feedback_category", "sentiment", "urgency"]
CLASS_COLUMNS = [*LABELS, "reasoning", "classified_at"]
REVIEW_COLUMNS = [
    "review_id", "product_category", "product_title", "review_text", "rating", "review_date", "quarter",
    "verified_purchase",
]
COUNT_COLUMNS = ["product_category", "quarter", "verified_purchase", "review_date"]
COUNT_KEYS = ["review_id", *COUNT_COLUMNS]


def latest_classification(classifications: DataFrame) -> DataFrame:
    """The newest classification per review, ties broken by label (one map-side combined aggregate)."""
    order = ["classified_at", *LABELS, "reasoning"]
    return (
        classifications.where(F.col("review_id").isNotNull()).groupBy("review_id")
        .agg(F.max(F.struct(*order)).alias("last"))
        .select("review_id", *[F.col(f"last.{c}").alias(c) for c in CLASS_COLUMNS])
    )


def classified_ids(classifications: DataFrame) -> DataFrame:
    """Distinct review ids that have a classification."""
    return classifications.where(F.col("review_id").isNotNull()).select("review_id").distinct()


def feedback_view(reviews: DataFrame, classifications: DataFrame, dedupe: str | None = None) -> DataFrame:
    """All reviews with their classifications, if any; a reclassified review gives several rows.

    An outer join cannot split a hot key of its optional side, an inner join can. So the
    matched part is an inner join and the rest an anti join on distinct ids; both read
    one shuffle of the reviews.
    dedupe="latest" keeps the newest classification only, where a plain left join is safe.
    """
    left = reviews.select(*[c for c in REVIEW_COLUMNS if c in reviews.columns]).where("review_id IS NOT NULL")
    if dedupe == "latest":
        return left.join(latest_classification(classifications), "review_id", "left")
    matched = left.join(classifications.select("review_id", *CLASS_COLUMNS), "review_id")
    pending = left.join(classified_ids(classifications), "review_id", "left_anti")
    types = dict(matched.dtypes)
    return matched.unionByName(pending.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in CLASS_COLUMNS]))


def counting_view(reviews: DataFrame, classifications: DataFrame, dedupe: str | None = None) -> DataFrame:
    """The columns of the joined rows that counts need; texts stay out of the shuffle.

    A filter on a label empties the part without classifications, and Catalyst then drops its join.
    """
    return feedback_view(reviews.select(*COUNT_KEYS), classifications, dedupe).select(*COUNT_COLUMNS, *LABELS)


def latest_reviews(reviews: DataFrame, classifications: DataFrame, limit: int = 1500) -> DataFrame:
    """The newest `limit` joined rows; missing dates come first.

    Every review gives at least one joined row, so only the newest `limit` reviews can
    appear. They are found on two narrow columns first; their oldest date, a scalar subquery, then lets the
    scan of the wide columns skip the rest. Nothing is broadcast by a hint: what is joined is known by its size at run time.
    """
    newest = [F.col("review_date").desc_nulls_first(), F.col("review_id")]
    keys = reviews.select("review_id", "review_date").orderBy(*newest).limit(limit)
    oldest = keys.agg(F.min("review_date").alias("oldest")).select("oldest").scalar()
    recent = F.col("review_date").isNull() | (F.col("review_date") >= oldest)
    ids = keys.select("review_id")
    top = reviews.select(*REVIEW_COLUMNS).where(recent).join(ids, "review_id", "left_semi")
    matched = classifications.select("review_id", *CLASS_COLUMNS).join(top, "review_id")
    seen = classifications.select("review_id").join(ids, "review_id", "left_semi").distinct()
    pending = top.join(seen, "review_id", "left_anti")
    types = dict(matched.dtypes)
    rows = matched.select(*REVIEW_COLUMNS, *CLASS_COLUMNS).unionByName(
        pending.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in CLASS_COLUMNS])
    )
    ties = [F.col(c).asc_nulls_first() for c in ("classified_at", *LABELS, "reasoning")]
    return rows.orderBy(*newest, *ties).limit(limit)


def pending_reviews(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    """Reviews that have no classification yet. Ids are compared first, and only the texts of the few left are fetched."""
    ids = reviews.select("review_id").join(classified_ids(classifications), "review_id", "left_anti")
    return reviews.join(ids, "review_id", "left_semi")


def lookup_rows(reviews: DataFrame, classifications: DataFrame, review_id: str | None) -> DataFrame:
    """The review with this id and its newest classification; both filters reach the scans."""
    hit = lambda df: df.where(F.col("review_id") == review_id)
    return (
        hit(reviews).join(latest_classification(hit(classifications)), "review_id", "left")
        .select(
            "review_id", "product_category", "product_title", "review_text", "rating", "review_date",
            "verified_purchase", *LABELS, "reasoning",
        )
    )


def lookup_pairs(reviews: DataFrame, classifications: DataFrame, review_id: str | None) -> DataFrame:
    """(position, column, value) of one review; every value as text, a missing one as 'None'."""
    row = lookup_rows(reviews, classifications, review_id)
    cell = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")) if dict(row.dtypes)[c] == "boolean"
                                else F.col(c).cast("string"), F.lit("None"))
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), cell(c).alias("value"))
        for i, c in enumerate(row.columns)
    ])))


def reprocess_queue(classifications: DataFrame, fallback_reasoning: str) -> DataFrame:
    """Reviews whose newest good classification, if any, is older than a fallback row."""
    failed = F.col("reasoning") == fallback_reasoning
    last = classifications.where(F.col("review_id").isNotNull()).groupBy("review_id").agg(
        F.max(F.when(failed, F.col("classified_at"))).alias("failed_at"),
        F.max(F.when(~failed, F.col("classified_at"))).alias("good_at"),
    )
    return last.where(
        F.col("failed_at").isNotNull() & (F.col("good_at").isNull() | (F.col("good_at") <= F.col("failed_at")))
    ).select("review_id", "failed_at")


