import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from voc_spark.functions.times import epoch_ms, epoch_ms_to_ts, ntz
from voc_spark.operators import prep, sampling


def test_epoch_conversion_ignores_session_zone(spark):
    df = spark.range(1).select(epoch_ms_to_ts(F.lit(1648684800123)).cast("string").alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert rows(df) == [("2022-03-31 00:00:00.123",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_window_includes_end_midnight_only(spark):
    times = ["2021-12-31T23:59:59.999", "2022-01-01", "2022-06-30", "2022-06-30T00:00:00.001"]
    df = spark.createDataFrame([(epoch_ms(t),) for t in times], "timestamp long")
    assert prep.window_filter(df).count() == 2


def test_quarter_label_ends_at_midnight(spark):
    label = lambda t: rows(spark.range(1).select(prep.quarter_label(ntz(t))))[0][0]
    assert label("2022-03-31 00:00:00") == "Q1 2022"
    assert label("2022-03-31 12:00:00") == "Q2 2022"


def test_rating_bands(spark):
    df = spark.createDataFrame([(r,) for r in (1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, None)], "r double")
    assert [b for b, in rows(df.select(prep.rating_band(F.col("r"))))] == [
        "low", "low", None, "mid", None, "high", "high", None]


def test_review_key_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", "u"), (None, "u")], "asin string, user_id string")
    assert rows(df.select(prep.review_key())) == [("a_u",), (None,)]


def _raw(spark, low, mid, high, copies=0):
    data = [(f"l{i}", 1.0) for i in range(low)] + [(f"m{i}", 3.0) for i in range(mid)] + [(f"h{i}", 5.0) for i in range(high)]
    data += [("hot", 5.0)] * copies + [("x", 2.5), ("y", None)]
    return spark.createDataFrame([(a, "u", 0, "Toys", r) for a, r in data],
                                 "asin string, user_id string, timestamp long, product_category string, rating double")


def _bands(sample):
    return dict(rows(sample.groupBy(prep.rating_band(F.col("rating"))).count()))


def test_quotas_truncate_in_floating_point(spark):
    sample = sampling.stratified_sample(_raw(spark, 200, 200, 300), 180)
    assert _bands(sample) == {"low": 62, "mid": 27, "high": 91}


def test_scarce_low_and_mid_are_filled_by_high(spark):
    sample = sampling.stratified_sample(_raw(spark, 3, 0, 300), 100)
    assert _bands(sample) == {"low": 3, "high": 97}


def test_short_high_stratum_raises_or_gives_all(spark):
    raw = _raw(spark, 100, 100, 10)
    with pytest.raises(ValueError, match="Toys"):
        sampling.stratified_sample(raw, 100)
    assert _bands(sampling.stratified_sample(raw, 100, on_short="take_all")) == {"low": 35, "mid": 15, "high": 10}


def test_category_without_high_rows_raises(spark):
    with pytest.raises(ValueError):
        sampling.stratified_sample(_raw(spark, 100, 100, 0), 100)


def test_sample_is_a_reproducible_subset_by_hash_order(spark):
    raw = _raw(spark, 50, 50, 400)
    first, again = (rows(sampling.stratified_sample(raw, 40, seed=7).select("asin")) for _ in range(2))
    assert first == again and len(set(first)) == 40
    assert first != rows(sampling.stratified_sample(raw, 40, seed=8).select("asin"))
    key = sampling.sample_hash(["asin", "user_id", "timestamp"], 7)
    best = rows(raw.where("rating = 5").orderBy(key).limit(20).select("asin"))
    assert set(best) <= set(first)


def test_a_third_of_equal_rows_does_not_change_the_size(spark):
    sample = sampling.stratified_sample(_raw(spark, 50, 50, 200, copies=150), 120)
    assert sample.count() == 120


def test_sample_profile(spark):
    df = spark.createDataFrame(
        [("a", "Toys", "Q1", 1.0), ("a", "Toys", "Q1", 2.0), ("b", "Books", None, 4.0), ("c", "Toys", "Q2", None)],
        "review_id string, product_category string, quarter string, rating double")
    got = {(s, i): v for s, i, v in rows(sampling.sample_profile(df))}
    assert got[("sample", "rows")] == 4 and got[("sample", "unique_ids")] == 3
    assert got[("quarter", "Q1")] == 2 and ("quarter", None) not in got
    assert got[("rating", "count")] == 3 and got[("rating", "50%")] == 2 and got[("rating", "25%")] == 1.5
    assert round(got[("rating", "std")], 6) == 1.527525
