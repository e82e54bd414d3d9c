import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from voc_spark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text):
    return datetime.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def reviews(spark):
    rows = [
        # id, category, date, quarter, verified
        ("a", "Toys", "1997-01-01 00:00:00", "Q1", True),
        ("b", "Toys", "1997-01-31 00:00:00", "Q1", False),
        ("c", "Toys", "1997-01-31 00:00:01", "Q1", True),
        ("d", "Books", "1997-02-10 09:30:00", "Q1", None),
        ("e", "Books", None, "Q2", False),
        ("f", "Books", "1997-06-30 12:00:00", "Q2", True),
    ]
    return spark.createDataFrame(
        [(i, c, f"title {i}", f"text {i}", 3.0, ts(d), q, v) for i, c, d, q, v in rows],
        "review_id string, product_category string, product_title string, review_text string, rating double,"
        " review_date timestamp_ntz, quarter string, verified_purchase boolean",
    )


@pytest.fixture(scope="session")
def classifications(spark):
    rows = [
        ("a", "Not As Described", "Negative", "High", "first", "1997-01-02"),
        ("a", "Praise/Positive", "Positive", "Low", "second", "1997-01-03"),
        ("b", "Not As Described", "Negative", "Medium", "one", "1997-02-01"),
        ("d", "Praise/Positive", "Positive", "Low", "one", "1997-02-11"),
        ("e", "Pricing/Value Complaint", "Negative", "Medium", "one", "1997-02-12"),
        ("gone", "Not As Described", "Negative", "High", "orphan", "1997-01-02"),
        (None, "Not As Described", "Negative", "High", "no review", "1997-01-02"),
    ]
    return spark.createDataFrame(
        [(*r[:5], ts(r[5])) for r in rows],
        "review_id string, feedback_category string, sentiment string, urgency string, reasoning string,"
        " classified_at timestamp_ntz",
    )


@pytest.fixture(scope="session")
def view(reviews, classifications):
    from voc_spark.operators.joins import counting_view

    return counting_view(reviews, classifications)


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().toString()
