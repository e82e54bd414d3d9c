from datetime import datetime

from pyspark.sql import Window, functions as F

from tests.conftest import plan
from voc_spark.functions.times import epoch_ms_to_ts, ntz
from voc_spark.operators.prep import review_key
from voc_spark.session import fresh_dir
from voc_spark.sources import demo_tables as demo


def star(spark):
    """Line items of repeated keys, rows given twice, missing customers, parts and dates."""
    folder, day = fresh_dir(spark, "star"), datetime(1997, 1, 1)
    lines = [(o, n, p, float(o % 7), 10.0 * n, "F", None if o == 5 else day.replace(month=1 + o % 12))
             for o in range(1, 40) for n, p in ((1, o % 4), (2, 9), (3, None))]
    spark.createDataFrame(lines + lines[:6], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, "
                          "l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, None if o % 9 == 0 else o % 5) for o in [*range(1, 40), 4]], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(p, f"type {p}", f"name {p}") for p in (0, 1, 2, 3, 3)], "p_partkey bigint, p_type string, p_name string").write.parquet(f"{folder}/part.parquet")
    return folder


def test_reviews_are_the_first_raw_row_of_every_key(spark):
    folder = star(spark)
    first = Window.partitionBy("review_id").orderBy(*demo.RAW_ORDER)
    ts = epoch_ms_to_ts(F.col("timestamp"))
    wanted = demo.raw_reviews(spark, folder).withColumn("review_id", review_key()).withColumn("rn", F.row_number().over(first)).where("rn = 1").select(
        "review_id", "product_category", "product_title", F.col("text").alias("review_text"), "rating", ts.alias("review_ts"),
        F.when(F.col("l_orderkey") % 997 != 0, ts).alias("review_date"), F.when(ts <= ntz(demo.Q1_END), "Q1").otherwise("Q2").alias("quarter"),
        "verified_purchase", "l_orderkey", "l_linenumber").collect()
    got = demo.reviews(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and [r.review_id for r in got].count(None) == 1


def test_review_texts_are_in_no_shuffle_by_key(spark):
    """One clustering by part serves the choice per key and the join with the part; texts are made after it."""
    made = plan(demo._build_reviews(spark, star(spark)))
    physical = made[made.index("== Physical Plan =="):]
    assert "hashpartitioning(review_id" not in physical and "hashpartitioning(l_partkey" in physical
