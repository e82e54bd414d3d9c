import pytest

from tests.conftest import rows
from voc_spark.operators import counts, filters, joins, profile
from voc_spark.operators.joins import counting_view


def one(df):
    return df.first()[0]


def test_joined_rows_fan_out_and_keep_unclassified(view, reviews, classifications):
    assert one(counts.count_query(view)) == 7
    assert joins.feedback_view(reviews, classifications).count() == 7
    assert one(counts.count_query(counting_view(reviews, classifications, dedupe="latest"))) == 6
    latest = joins.feedback_view(reviews, classifications, dedupe="latest").where("review_id = 'a'").first()
    assert latest.reasoning == "second"


def test_falsy_filters_are_ignored_but_false_is_not(view):
    assert one(counts.count_query(view, sentiment="", product_category=None)) == 7
    assert one(counts.count_query(view, verified_purchase=False)) == 2
    assert one(counts.count_query(view, sentiment="Negative", product_category="Toys")) == 2
    assert one(counts.count_query(view, sentiment="No such value")) == 0


def test_date_filter_needs_both_ends_and_stops_at_midnight(view):
    assert one(counts.count_query(view, date_start="1997-01-01")) == 7
    assert one(counts.count_query(view, date_start="1997-01-01", date_end="1997-01-31")) == 3
    assert one(counts.count_query(view, date_start="1997-01-01", date_end="1997-01-31", end_of_day=True)) == 4


def test_breakdown_ignores_date_and_verified_unless_strict(view):
    spec = dict(date_start="1997-01-01", date_end="1997-01-31", verified_purchase=True)
    assert rows(counts.breakdown_query(view, "sentiment", **spec)) == [("Negative", 3), ("Positive", 2), ("null", 2)]
    assert rows(counts.breakdown_query(view, "sentiment", strict=True, **spec)) == [("Negative", 1), ("Positive", 1)]
    assert rows(counts.chart_query(view, "sentiment", **spec)) == [("Negative", 2), ("Positive", 1)]
    assert rows(counts.breakdown_query(view, "verified_purchase")) == [("true", 4), ("false", 2), ("null", 1)]


@pytest.mark.parametrize("column", ["product_category", "feedback_category", "sentiment", "urgency", "quarter", "verified_purchase"])
def test_breakdown_adds_up_to_the_count(view, column):
    assert sum(n for _, n in rows(counts.breakdown_query(view, column, product_category="Toys"))) == one(
        counts.count_query(view, product_category="Toys"))


def test_bad_column_is_refused(view):
    with pytest.raises(ValueError, match="'rating' isn't a valid column to break down by."):
        counts.breakdown_query(view, "rating")
    with pytest.raises(ValueError, match="to chart by"):
        counts.chart_query(view, None)


def test_cube_answers_like_the_rows(view):
    cube = counts.feedback_cube(view)
    for spec in (
        {}, {"sentiment": "Negative"}, {"verified_purchase": False}, {"date_start": "1997-01-01", "date_end": "1997-01-31"},
        {"date_start": "1997-01-01", "date_end": "1997-01-31", "end_of_day": True}, {"urgency": "Low", "product_category": "Books"},
    ):
        assert one(counts.count_query(cube, **spec)) == one(counts.count_query(view, **spec))
    assert rows(counts.breakdown_query(cube, "feedback_category")) == rows(counts.breakdown_query(view, "feedback_category"))


def test_snapshot_puts_missing_dates_first_and_is_cut_before_filters(reviews, classifications):
    ids = [r.review_id for r in joins.latest_reviews(reviews, classifications, 4).collect()]
    assert ids == ["e", "f", "d", "c"]
    assert [r.review_id for r in joins.latest_reviews(reviews, classifications, 6).collect()][-1] == "a"
    snapshot = joins.latest_reviews(reviews, classifications, 4)
    got = {(d, v): n for d, v, n in rows(counts.aggregated_stats(snapshot, product_category="Books"))}
    assert got[("total", "all")] == 3 and got[("sentiment", "Positive")] == 1
    assert ("sentiment", None) not in got and ("product_category", "Toys") not in got


def test_top_themes_and_ties(reviews, classifications):
    snapshot = joins.latest_reviews(reviews, classifications)
    assert rows(counts.top_themes(snapshot, 2)) == [("Not As Described", 2), ("Praise/Positive", 2)]


def test_multi_select(reviews, classifications):
    snapshot = joins.latest_reviews(reviews, classifications)
    assert filters.filter_multi_select(snapshot, sentiment=["Negative", "Positive"], urgency=["Low"], product_category=[]).count() == 2
    with pytest.raises(ValueError):
        filters.filter_multi_select(snapshot, rating=["1"])


def test_dashboard_positions_and_banner(reviews, classifications):
    got = rows(counts.dashboard_charts(joins.latest_reviews(reviews, classifications)))
    urgency = sorted((p, v) for d, p, v, _ in got if d == "urgency")
    assert urgency == [(1, "Low"), (2, "Medium"), (3, "High")]
    assert ("banner", 0, "Showing 7 reviews matching current filters", 7) in got


def test_empty_tables(spark, reviews, classifications):
    none, no_labels = reviews.where("false"), classifications.where("false")
    empty = counting_view(none, no_labels)
    assert one(counts.count_query(empty)) == 0
    assert rows(counts.aggregated_stats(joins.latest_reviews(none, no_labels))) == [("total", "all", 0)]
    assert rows(profile.coverage(none)) == [(0, None, None)]


def test_profile(reviews, classifications):
    got = rows(profile.schema_profile(reviews, classifications))
    assert {p for p, *_ in got} == set(range(9)) and {r[-1] for r in got} == {6}
    by_column = {}
    for _, c, _, _, _, v, _ in got:
        by_column.setdefault(c, set()).add(v)
    assert by_column["quarter"] == {"Q1", "Q2"} and by_column["rating"] == {None}
    assert [r[3] for r in got if r[1] == "review_date"] == ["1997-01-01 00:00:00 to 1997-06-30 12:00:00"]


def test_preview(reviews, classifications):
    cut = profile.table_preview(reviews, "reviews", 2, 4, "review_id")
    assert rows(cut.select("product_title", "rating")) == [("titl", "3.0")] * 2
    assert profile.table_preview(classifications, "classifications").count() == 7
    with pytest.raises(ValueError):
        profile.table_preview(reviews, "summaries")


def test_lookup(reviews, classifications):
    pairs = {c: v for _, c, v in rows(joins.lookup_pairs(reviews, classifications, "a"))}
    assert pairs["reasoning"] == "second" and pairs["verified_purchase"] == "True" and len(pairs) == 11
    assert {c: v for _, c, v in rows(joins.lookup_pairs(reviews, classifications, "c"))}["sentiment"] == "None"
    assert joins.lookup_pairs(reviews, classifications, None).count() == 0


def test_pending_and_reprocess(spark, reviews, classifications):
    assert sorted(rows(joins.pending_reviews(reviews, classifications).select("review_id"))) == [("c",), ("f",)]
    assert joins.reprocess_queue(classifications, "first").count() == 0  # 'a' has a later good row
    assert rows(joins.reprocess_queue(classifications, "second").select("review_id")) == [("a",)]


def test_hot_classification_key(spark, reviews):
    many = spark.range(3000).selectExpr(
        "'a' AS review_id", "'Not As Described' AS feedback_category", "'Negative' AS sentiment", "'High' AS urgency",
        "cast(id AS string) AS reasoning", "timestampadd(SECOND, cast(id AS int), timestamp_ntz'1997-01-01') AS classified_at")
    assert one(counts.count_query(counting_view(reviews, many))) == 3005
    assert joins.pending_reviews(reviews, many).count() == 5
    assert joins.latest_reviews(reviews, many, 1500).count() == 1500
    assert joins.latest_classification(many).first().reasoning == "2999"


def test_large_limit_takes_the_same_rows_without_a_hint(reviews, classifications):
    small, large = (joins.latest_reviews(reviews, classifications, n) for n in (1000, 20_000))
    assert rows(small) == rows(large)


def test_shuffle_partitions_follow_the_input():
    from voc_spark.session import shuffle_partitions

    assert shuffle_partitions(10) == 200 and shuffle_partitions(100 * 2**40) == 409600
