"""The plans that make the jobs scale: what is pushed down, what is cut before a shuffle, what never happens."""

import pytest

from tests.conftest import plan
from voc_spark.operators import counts, joins
from voc_spark.plans.catalog import QUERIES
from voc_spark.plans.oracles import all_oracles
from voc_spark.sources import demo_tables as demo

FOLDER = "/root/testdata/sf0.001"
MODEL_JOBS = {"classify_model"}


@pytest.fixture(scope="module")
def shuffle_joins(spark):
    """Plans as they are when no side is small enough to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(all_oracles())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("stream_ingest_classify",)])
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = any(word in text for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"))
    assert python == (name in MODEL_JOBS)


@pytest.mark.parametrize("name", ["stratified_sample", "context_window", "insert_if_absent"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, FOLDER))


def test_latest_reviews_is_a_top_k_without_a_forced_broadcast(spark, shuffle_joins):
    df = joins.latest_reviews(demo.reviews(spark, FOLDER), demo.classifications(spark, FOLDER), 100)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" not in text
    assert "scalar-subquery" in text.lower() or "Subquery" in text


@pytest.mark.parametrize("name", ["aggregated_stats", "top_themes", "dashboard_charts", "filter_multi_select", "drilldown_rows"])
def test_statistics_cover_all_rows_without_a_forced_broadcast(spark, shuffle_joins, name):
    text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "LocalLimit 1000" not in text
    assert name == "drilldown_rows" or "review_text:string" not in text


def test_pending_ids_are_compared_without_their_texts(spark, shuffle_joins):
    df = joins.pending_reviews(demo.reviews(spark, FOLDER), demo.classifications(spark, FOLDER))
    anti = df._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[1]
    assert "review_text" not in anti.split("Relation")[0]


def test_label_filter_drops_the_part_without_labels(spark, shuffle_joins):
    view = joins.counting_view(demo.reviews(spark, FOLDER), demo.classifications(spark, FOLDER))
    text = counts.count_query(view, sentiment="Negative")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in text and "LeftOuter" not in text and text.count("SortMergeJoin") == 1
    assert "EqualTo(sentiment,Negative)" in text
    assert "review_text" not in text


def test_both_parts_read_one_shuffle_of_the_reviews(spark, shuffle_joins):
    view = joins.counting_view(demo.reviews(spark, FOLDER), demo.classifications(spark, FOLDER))
    df = counts.breakdown_query(view, "sentiment")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_date_window_reaches_the_scan(spark):
    text = plan(QUERIES["window_filter"](spark, FOLDER))
    assert "GreaterThanOrEqual(timestamp" in text and "LessThanOrEqual(timestamp" in text


def test_lookup_filters_both_scans(spark):
    text = plan(joins.lookup_rows(demo.reviews(spark, FOLDER), demo.classifications(spark, FOLDER), "7_31"))
    assert text.count("EqualTo(review_id,7_31)") >= 2


def test_text_is_scanned_for_terms_once(spark):
    df = QUERIES["classify_rules"](spark, FOLDER)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("split(lower(") == 1


def test_snapshot_stats_leave_the_texts_unread(spark):
    assert "review_text:string" not in QUERIES["top_themes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_a_hot_review_is_split_over_tasks(spark, shuffle_joins):
    """A third of all classifications belong to one review; the join splits that partition."""
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 20000, 1, 8)
        reviews = ids.selectExpr(
            "cast(id AS string) AS review_id", "'Toys' AS product_category", "'t' AS product_title", "'x' AS review_text",
            "3.0D AS rating", "timestamp_ntz'2022-01-01' AS review_date", "'Q1' AS quarter", "true AS verified_purchase")
        labels = spark.range(0, 300000, 1, 8).selectExpr(
            "if(id % 3 = 0, '7', cast(id % 19000 AS string)) AS review_id", "'Not As Described' AS feedback_category",
            "'Negative' AS sentiment", "'High' AS urgency", "md5(cast(id AS string)) AS reasoning",
            "timestamp_ntz'2022-01-02' AS classified_at")
        df = joins.feedback_view(reviews, labels)
        assert len(df.select("review_id", "reasoning").collect()) == 301000
        collected = df.select("review_id", "reasoning")
        collected.collect()
        assert "skew=true" in collected._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
