"""Table rules as audits: not null, unique, foreign key, well-formed classification JSON."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voc_spark import taxonomy as tx
from voc_spark.schemas import UNIQUE_KEYS, required_columns


def audit_not_null_unique(df: DataFrame, required: Sequence[str], key: str | None = None) -> DataFrame:
    """(rule, violations) per required column and for the key; the key rule counts surplus rows.

    Null counts come from one pass; surplus rows of the key from a map-side combined count.
    """
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    out = nulls.select(F.inline(F.array(*[
        F.struct(F.lit(f"{c} is not null").alias("rule"), F.col(c).alias("violations")) for c in required
    ])))
    if key:
        per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        surplus = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(surplus.select(F.lit(f"{key} is unique").alias("rule"), "violations"))
    return out


def audit_table(df: DataFrame, table: str) -> DataFrame:
    """The audit with the rules of a stored table."""
    return audit_not_null_unique(df, required_columns(table), UNIQUE_KEYS.get(table))


def orphan_classifications(classifications: DataFrame, reviews: DataFrame) -> DataFrame:
    """Classifications whose review does not exist; a null review_id passes, as in a foreign key."""
    return classifications.where(F.col("review_id").isNotNull()).join(
        reviews.select("review_id"), "review_id", "left_anti"
    )


DOMAINS = {
    "feedback_category": tx.FEEDBACK_CATEGORIES,
    "sentiment": tx.SENTIMENTS,
    "urgency": tx.URGENCIES,
    "reasoning": None,
}


def validate_classification_json(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Adds the four parsed fields and `problem`, null for a valid answer.

    Every field must be a JSON string, the labels must be in their domain, and further keys
    are ignored. The value type is read from the variant, since a cast would take 5 as "5".
    """
    parsed = df.withColumn("_v", F.try_parse_json(raw))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))

    def problem(name: str, domain: list[str] | None) -> Column:
        field = F.try_variant_get("_v", f"$.{name}", "variant")
        text = F.try_variant_get("_v", f"$.{name}", "string")
        found = F.when(field.isNull(), f"missing {name}").when(
            F.schema_of_variant(field) != "STRING", f"{name} is no string"
        )
        return found.when(~text.isin(domain), f"{name} outside its domain") if domain else found

    checked = parsed.withColumn(
        "problem",
        F.when(~is_object, "not a JSON object").otherwise(F.coalesce(*[problem(n, d) for n, d in DOMAINS.items()])),
    )
    ok = F.col("problem").isNull()
    fields = {n: F.when(ok, F.try_variant_get("_v", f"$.{n}", "string")) for n in DOMAINS}
    return checked.withColumns(fields).drop("_v")


def with_fallback(validated: DataFrame) -> DataFrame:
    """The fallback label in place of every invalid answer."""
    return validated.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in tx.FALLBACK.items()})
