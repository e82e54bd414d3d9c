import json
import random
from datetime import datetime, timedelta

import pytest

from tests.conftest import rows, ts
from voc_spark import taxonomy as tx
from voc_spark.operators import counts, specs, windows
from voc_spark.plans import answers, summaries


@pytest.fixture(scope="module")
def facts(spark):
    """Random joined rows, many of them exactly at midnight."""
    rnd = random.Random(3)
    data = []
    for _ in range(600):
        day = datetime(2022, 1, 1) + timedelta(days=rnd.randrange(40))
        at = None if rnd.random() < 0.05 else day + timedelta(seconds=rnd.choice([0, 0, 1, 50000]))
        labels = (None, None, None) if rnd.random() < 0.2 else (
            rnd.choice(tx.FEEDBACK_CATEGORIES), rnd.choice(tx.SENTIMENTS), rnd.choice(tx.URGENCIES))
        data.append((rnd.choice(["Toys", "Books"]), rnd.choice([True, False, None]), at, *labels, "Q1"))
    frame = spark.createDataFrame(
        data, "product_category string, verified_purchase boolean, review_date timestamp_ntz, feedback_category string,"
              " sentiment string, urgency string, quarter string").cache()
    return data, frame


WINDOWS = [
    ("all", "2021-01-01", "2023-01-01"), ("inside", "2022-01-05", "2022-01-09"), ("day", "2022-01-07", "2022-01-07"),
    ("before", "2021-01-01", "2021-12-31"), ("after", "2022-03-01", "2022-04-01"), ("reversed", "2022-01-09", "2022-01-05"),
    ("tail", "2022-02-01", "2022-02-09"), ("head", "2021-12-01", "2022-01-01"),
]


def brute(data, start, end, end_of_day):
    lo = datetime.fromisoformat(start)
    hi = datetime.fromisoformat(end) + (timedelta(days=1, microseconds=-1) if end_of_day else timedelta())
    out = {}
    for pc, _, at, fc, s, u, _ in data:
        if at is None or not lo <= at <= hi:
            continue
        cells = [("product_category", pc), ("feedback_category", fc), ("sentiment", s), ("urgency", u), ("total", "all")]
        if fc in tx.COMPLAINTS:
            cells.append(("complaints_by_product", pc))
        for cell in cells:
            if cell[1] is not None:
                out[cell] = out.get(cell, 0) + 1
    return out


@pytest.mark.parametrize("end_of_day", [False, True])
def test_window_counts_match_brute_force(spark, facts, end_of_day):
    data, frame = facts
    table = spark.createDataFrame(WINDOWS, "window_label string, date_start string, date_end string")
    want = {(label, *k): n for label, s, e in WINDOWS for k, n in brute(data, s, e, end_of_day).items()}
    got = {tuple(r[:3]): r[3] for r in rows(windows.window_counts(frame, table, end_of_day))}
    assert got == want
    from_cube = {tuple(r[:3]): r[3] for r in rows(windows.window_counts(counts.feedback_cube(frame), table, end_of_day))}
    assert from_cube == want


def test_profiles_json_and_narrative(spark, facts):
    data, frame = facts
    table = spark.createDataFrame(WINDOWS, "window_label string, date_start string, date_end string")
    profiles = windows.window_profiles(frame, table)
    assert {r.window_label for r in profiles.where("total_reviews = 0").collect()} == {"before", "after", "reversed"}
    stats = profiles.select("window_label", windows.stats_json().alias("stats"))
    whole = json.loads(stats.where("window_label = 'all'").first().stats)
    assert set(whole) == {"total_count", *windows.STAT_KEYS.values()}
    assert whole["total_count"] == brute(data, "2021-01-01", "2023-01-01", False)[("total", "all")]
    back = {tuple(r[:3]): r[3] for r in rows(windows.parse_stats(stats.where("stats IS NOT NULL")))}
    assert back == {tuple(r[:3]): r[3] for r in rows(windows.window_counts(frame, table)) if r[1] != "complaints_by_product"}
    texts = dict(rows(windows.with_narrative(profiles).select("window_label", "narrative")))
    assert texts["before"] is None and texts["all"].startswith(f"{whole['total_count']} reviews in all. Main themes: ")
    written = spark.createDataFrame([("all", "by a model")], "window_label string, narrative string")
    texts = dict(rows(windows.with_narrative(profiles, written).select("window_label", "narrative")))
    assert texts["all"] == "by a model" and texts["day"] == tx.SUMMARY_UNAVAILABLE and texts["after"] is None


def test_overlap_messages(spark, reviews):
    table = spark.createDataFrame(WINDOWS[:1] + [("early", "1990-01-01", "1996-12-31"), ("edge", "1997-06-30", "1997-07-30")],
                                  "window_label string, date_start string, date_end string")
    got = {r.window_label: (r.is_valid, r.message) for r in windows.date_range_overlap(table, reviews).collect()}
    available = "No data available in that range. Currently available: 1997-01-01 to 1997-06-30."
    assert got == {"all": (False, available), "early": (False, available), "edge": (True, None)}
    none = windows.date_range_overlap(table, reviews.where("false")).collect()
    assert all(not r.is_valid and "none to none" in r.message for r in none)


def test_summary_job_errors_and_storage(spark, reviews, classifications):
    from voc_spark.schemas import SUMMARIES
    from voc_spark.session import fresh_dir
    from voc_spark.sources.parquet import read_version

    table = spark.createDataFrame(
        [("1997-01-01", "1997-01-31"), ("1997-03-01", "1997-04-01"), ("1990-01-01", "1990-02-01"), ("1997-01-31", None)],
        "date_start string, date_end string")
    done = summaries.window_summaries(reviews, classifications, summaries.label_windows(table))
    got = {r.date_start: (r.success, r.error, r.total_reviews) for r in done.collect()}
    assert got["1997-01-01"] == (True, None, 3)
    assert got["1997-03-01"] == (False, tx.NO_REVIEWS_IN_RANGE, 0)
    assert got["1990-01-01"][1].startswith("No data available")
    assert got["1997-01-31"][0] is False
    root = fresh_dir(spark, "summaries")
    summaries.run_summaries(spark, root, reviews, classifications, table)
    kept = read_version(spark, root, SUMMARIES).collect()
    assert [r.window_label for r in kept] == ["Custom: 1997-01-01 to 1997-01-31"]


SPECS = [
    (1, None, None, None, None, None, None, None), (2, "Toys", None, "Negative", None, None, None, None),
    (3, None, None, None, None, False, None, None), (4, "Nope", None, None, None, None, None, None),
    (5, None, None, None, None, None, "2022-01-05", "2022-01-09"), (6, "Books", None, None, "High", True, "2022-01-01", "2022-02-09"),
    (7, None, None, None, None, None, "2022-01-09", "2022-01-05"), (8, None, None, None, None, None, "2022-01-05", None),
    (9, "", "", "", "", None, "", ""), (10, None, "Praise/Positive", None, None, None, "1990-01-01", "2050-01-01"),
]
FIELDS = ["product_category", "feedback_category", "sentiment", "urgency", "verified_purchase", "date_start", "date_end"]


def test_spec_counts_agree_one_by_one_list_and_table(spark, facts):
    _, frame = facts
    table = spark.createDataFrame(
        SPECS, "spec_id long, product_category string, feedback_category string, sentiment string, urgency string,"
               " verified_purchase boolean, date_start string, date_end string")
    as_dicts = [{"spec_id": s[0], **dict(zip(FIELDS, s[1:]))} for s in SPECS]
    single = {s["spec_id"]: counts.count_query(frame, **s).first()[0] for s in as_dicts}
    assert dict(rows(specs.count_spec_list(frame, as_dicts))) == single
    counted = specs.count_specs(frame, table)
    assert {r.spec_id: r["count"] for r in counted.collect()} == single
    assert counted.where("error IS NOT NULL").count() == 0


@pytest.mark.parametrize("start, end", [("1997-13-01", "1997-06-30"), ("soon", "1997-06-30"), ("1997-01-01", "1997-06-30 12:00:00")])
def test_bad_dates_stay_with_their_row(spark, facts, start, end):
    _, frame = facts
    good = (1, None, None, None, None, None, "2022-01-01", "2022-12-31")
    table = spark.createDataFrame(
        [good, (2, None, None, None, None, None, start, end)],
        "spec_id long, product_category string, feedback_category string, sentiment string, urgency string,"
        " verified_purchase boolean, date_start string, date_end string")
    got = {r.spec_id: (r["count"], r.error) for r in specs.count_specs(frame, table).collect()}
    assert got[1][1] is None and got[1][0] > 0 and got[2] == (0, tx.BAD_DATES_FORMAT % (start, end))
    wanted = spark.createDataFrame([("w", start, end), ("ok", "2022-01-01", "2022-12-31")], "window_label string, date_start string, date_end string")
    assert {r.window_label: r.total_reviews > 0 for r in windows.window_profiles(frame, wanted).collect()} == {"w": False, "ok": True}
    with pytest.raises(ValueError):
        counts.count_query(frame, date_start=start, date_end=end)


def test_a_stray_date_adds_one_row(spark, facts):
    _, frame = facts
    daily = windows.daily_marginals(frame)
    stray = daily.limit(1).selectExpr("dimension", "value", "date'9999-01-01' AS day", "rows", "midnight_rows")
    days = daily.select("day").distinct()
    assert windows.running_marginals(daily.unionByName(stray), days).count() == windows.running_marginals(daily, days).count()


def test_normalize_specs(spark, reviews):
    df = spark.createDataFrame(
        [(1, "count", "1997-03-01", "1997-02-01"), (2, "chart", "1990-01-01", "1997-01-15"), (3, "count", "2020-01-01", "2021-01-01"),
         (4, "count", "1997-02-01", None)], "spec_id int, query_type string, date_start string, date_end string"
    ).selectExpr("*", "'asked' AS explanation")
    got = {r.spec_id: r for r in specs.normalize_specs(df, reviews).collect()}
    assert (got[1].date_start, got[1].date_end) == ("1997-02-01", "1997-03-01") and "reordered" in got[1].explanation
    assert (got[2].query_type, got[2].date_start) == ("chart", "1997-01-01") and "clipped" in got[2].explanation
    assert got[3].query_type == "unsupported" and "1997-01-01 to 1997-06-30" in got[3].explanation
    assert (got[4].date_start, got[4].date_end, got[4].explanation) == ("1997-02-01", None, "asked")


def test_chart_types(spark):
    cases = [(["bar"], ["bar"]), (None, ["bar"]), ([], ["bar"]), (["radar"], ["bar"]), (["pie", "pie"], ["pie", "pie"]),
             (["line", "bar", "pie"], ["bar", "pie"]), (["pie", "line", "pie"], ["pie", "bar"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, chart_types array<string>")
    got = {r.i: (r.chart_types, r.note) for r in specs.normalize_chart_types(df).collect()}
    for i, (asked, want) in enumerate(cases):
        assert got[i] == (want, tx.LINE_NOTE if asked and "line" in asked else None)


@pytest.mark.parametrize("spec, kind, text", [
    ({"query_type": "breakdown", "breakdown_column": "rating"}, "message", "'rating' isn't a valid column to break down by."),
    ({"query_type": "chart", "group_by_column": None}, "message", "'None' isn't a valid column to chart by."),
    ({"query_type": "chart", "group_by_column": "sentiment", "sentiment": "Odd"}, "message", tx.NO_MATCH),
    ({"query_type": "lookup", "review_id": None}, "message", "No review found with ID 'None'."),
    ({"query_type": "unsupported"}, "message", "why"),
    ({"query_type": "summary"}, "message", "why"),
    ({"query_type": "summary", "date_start": "1990-01-01", "date_end": "1990-02-01"}, "message",
     "No data available in that range. Currently available: 1997-01-01 to 1997-06-30."),
    ({"query_type": "summary", "date_start": "1997-01-01", "date_end": "1997-01-31"}, "summary", "why"),
    ({"query_type": "count", "sentiment": "Negative"}, "count", "why"),
    ({"query_type": "count", "date_start": "1997-01-01", "date_end": "June"}, "message", tx.BAD_DATES_FORMAT % ("1997-01-01", "June")),
])
def test_answers(reviews, classifications, spec, kind, text):
    got = answers.run_spec(reviews, classifications, {**spec, "explanation": "why"}).collect()
    more = [("followup", text)] * 3 if kind == "summary" else []
    assert [(r.kind, r.explanation) for r in got] == [(kind, text), *more]


def test_answer_rows(reviews, classifications):
    spec = {"query_type": "breakdown", "breakdown_column": "sentiment", "explanation": "by tone"}
    got = [(r.kind, r.position, r.label, r.value) for r in answers.run_spec(reviews, classifications, spec).collect()]
    assert sorted(got) == [("table", 1, "Negative", "3"), ("table", 2, "Positive", "2"), ("table", 3, "null", "2")]
    assert ts("1997-01-01").year == 1997
