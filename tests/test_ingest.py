from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from voc_spark import schemas
from voc_spark.operators import constraints, ingest
from voc_spark.session import fresh_dir
from voc_spark.sources import parquet


def test_ingest_defaults(spark):
    base = "review_id string, product_category string, text string, rating double, review_date timestamp_ntz, quarter string"
    bare = spark.createDataFrame([("1", "Toys", "t", 1.0, None, "Q1")], base)
    assert rows(ingest.ingest_project(bare).select("product_title", "verified_purchase")) == [("Unknown Product", False)]
    full = bare.withColumn("product_title", F.lit(None).cast("string")).withColumn("verified_purchase", F.lit(None).cast("boolean"))
    assert rows(ingest.ingest_project(full).select("product_title", "verified_purchase")) == [(None, False)]


def test_insert_keeps_first_and_rerun_adds_nothing(spark):
    incoming = spark.createDataFrame(
        [("a", 2, "late"), ("a", 1, "early"), ("b", 1, "new"), ("old", 0, "again"), (None, 1, "no key")],
        "review_id string, at int, note string")
    target = spark.createDataFrame([("old",)], "review_id string")
    added = ingest.insert_if_absent(incoming, target, order=["at"])
    assert sorted(rows(added.select("review_id", "note"))) == [("a", "early"), ("b", "new")]
    assert ingest.insert_if_absent(incoming, target.unionByName(added.select("review_id")), order=["at"]).count() == 0
    assert rows(ingest.insert_report(incoming, added)) == [(5, 2, 3)]


def test_append_needs_a_review_unless_the_id_is_null(reviews, classifications):
    kept = ingest.append_classification(classifications, reviews)
    assert sorted((r.review_id or "") for r in kept.collect()) == ["", "a", "a", "b", "d", "e"]
    assert rows(constraints.orphan_classifications(classifications, reviews).select("review_id")) == [("gone",)]


def test_summaries_upsert_by_label_and_keep_old_versions(spark):
    root = fresh_dir(spark, "summaries")
    make = lambda *data: spark.createDataFrame(
        data, "window_label string, date_start string, date_end string, total_reviews long, stats string, narrative string"
    ).withColumns({c: F.col(c).cast("date") for c in ("date_start", "date_end")})
    ingest.upsert_summaries(spark, root, make(("w1", "2022-01-01", "2022-01-31", 1, "{}", "one"), ("w2", "2022-02-01", "2022-02-28", 2, "{}", "two")))
    version = ingest.upsert_summaries(spark, root, make(("w2", "2022-02-01", "2022-02-27", 3, "{}", "new")))
    now = parquet.read_version(spark, root, schemas.SUMMARIES)
    assert version == 1
    assert sorted(rows(now.select("window_label", "total_reviews", "narrative"))) == [("w1", 1, "one"), ("w2", 3, "new")]
    assert parquet.read_version(spark, root, schemas.SUMMARIES, 0).where("narrative = 'two'").count() == 1
    assert ingest.stored_summary(now, "w2").first().total_reviews == 3
    assert ingest.stored_summary(now, "w9").count() == 0


def test_upsert_keeps_one_row_per_key(spark):
    make = lambda *r: spark.createDataFrame(r, "window_label string, total_reviews long, narrative string")
    got = ingest.upsert(make(("w1", 2, "b"), ("w1", 3, "a"), (None, 1, "x")), make(("w1", 9, "old"), ("w2", 1, "kept")))
    assert sorted(rows(got)) == [("w1", 3, "a"), ("w2", 1, "kept")]


def test_scratch_is_deleted_with_its_job(spark):
    with parquet.scratch(spark):
        path = parquet.stored(spark.range(3), "gone").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists()


def test_init_tables_is_repeatable(spark):
    root = fresh_dir(spark, "tables")
    paths = parquet.init_tables(spark, root)
    spark.createDataFrame([("w", None, None, 1, "{}", "n", None)], "window_label string, date_start date, date_end date,"
                          " total_reviews long, stats string, narrative string, generated_at timestamp").write.mode("append").parquet(paths["summaries"])
    parquet.init_tables(spark, root)
    assert spark.read.schema(schemas.SUMMARIES).parquet(paths["summaries"]).count() == 1
    assert spark.read.schema(schemas.REVIEWS).parquet(paths["reviews"]).count() == 0
    assert schemas.required_columns("classifications") == ["feedback_category", "sentiment", "urgency", "reasoning"]


def test_audit_counts_nulls_and_surplus_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "z"), (None, "y")], "review_id string, review_text string")
    assert dict(rows(constraints.audit_not_null_unique(df, ["review_id", "review_text"], "review_id"))) == {
        "review_id is not null": 1, "review_text is not null": 1, "review_id is unique": 2}


GOOD = '{"feedback_category": "Not As Described", "sentiment": "Negative", "urgency": "Low", "reasoning": "r"%s}'


@pytest.mark.parametrize("raw, problem", [
    (GOOD % "", None),
    (GOOD % ', "extra": {"a": 1}', None),
    ('{"feedback_category": "Not As Described", "sentiment": "Negative", "urgency": "Low"}', "missing reasoning"),
    (GOOD.replace('"Negative"', '"Bad"') % "", "sentiment outside its domain"),
    (GOOD.replace('"r"', "5") % "", "reasoning is no string"),
    (GOOD.replace('"Low"', "null") % "", "urgency is no string"),
    ("{broken", "not a JSON object"),
    ("[1]", "not a JSON object"),
    (None, "not a JSON object"),
])
def test_classification_json(spark, raw, problem):
    df = spark.createDataFrame([(raw,)], "raw_json string")
    row = constraints.validate_classification_json(df).first()
    assert row.problem == problem
    assert row.feedback_category == ("Not As Described" if problem is None else None)
    filled = constraints.with_fallback(constraints.validate_classification_json(df)).first()
    assert filled.feedback_category == ("Not As Described" if problem is None else "Insufficient Context")


def test_upsert_ranks_only_rows_whose_key_comes_again(spark):
    """Rows with a key of their own are neither shuffled whole nor ranked: the ranking reads the few repeated keys."""
    schema = "window_label string, total_reviews bigint, narrative string"
    incoming = spark.createDataFrame([(f"w{i % 990}", i, "text " * 50) for i in range(1000)] + [(None, 1, "x")], schema)
    got = ingest.upsert(incoming, spark.createDataFrame([("w1", 5, "old"), ("kept", 6, "old")], schema))
    assert {r.window_label: r.total_reviews for r in got.collect()} == {**{f"w{i}": 990 + i if i < 10 else i for i in range(990)}, "kept": 6}
    assert got.count() == 991
    physical = plan(got)
    physical = physical[physical.index("== Physical Plan =="):]
    assert "LeftSemi, BuildRight" in physical[physical.index("Window"):]
