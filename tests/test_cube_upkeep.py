"""The feedback cube kept by signed deltas equals the cube recomputed from all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voc_spark.operators.counts import feedback_cube
from voc_spark.operators.joins import counting_view
from voc_spark.plans import cube_upkeep
from voc_spark.session import fresh_dir

REVIEWS = "review_id string, product_category string, quarter string, verified_purchase boolean, review_date timestamp_ntz, batch int"
CLASSES = "review_id string, feedback_category string, sentiment string, urgency string, reasoning string, classified_at timestamp_ntz, batch int"


def random_run(seed, batches=6):
    rnd = random.Random(seed)
    start = datetime(1997, 1, 1)
    reviews, classes = [], []
    for b in range(batches):
        for _ in range(rnd.randint(0, 25)):
            rid = f"r{rnd.randint(0, 40)}"  # ids repeat across batches: only the first insert counts
            when = None if rnd.random() < 0.1 else start + timedelta(days=rnd.randint(0, 90), hours=rnd.choice([0, 0, 5]))
            reviews.append((rid, rnd.choice(["Toys", "Books"]), rnd.choice(["Q1", "Q2"]), rnd.choice([True, False, None]), when, b))
        for _ in range(rnd.randint(0, 25)):
            rid = rnd.choice([f"r{rnd.randint(0, 45)}", None])  # labels of unknown, later and missing ids as well
            classes.append((rid, rnd.choice(["Praise/Positive", "Not As Described"]), rnd.choice(["Positive", "Negative"]), rnd.choice(["Low", "High"]),
                            "x", start + timedelta(days=rnd.randint(0, 120), seconds=rnd.randint(0, 3)), b))
    return reviews, classes


def expected(spark, reviews, classes, dedupe):
    r = spark.createDataFrame(reviews, REVIEWS)
    order = ["batch", "review_date", "verified_purchase", "quarter", "product_category"]
    first = r.groupBy("review_id").agg(F.min(F.struct(*order)).alias("f"))
    kept = first.select("review_id", *[F.col(f"f.{c}").alias(c) for c in order])
    return feedback_cube(counting_view(kept, spark.createDataFrame(classes, CLASSES), dedupe))


@pytest.mark.parametrize("seed,dedupe", [(1, None), (2, None), (3, "latest"), (4, "latest")])
def test_maintained_cube_equals_recomputed(spark, seed, dedupe):
    reviews, classes = random_run(seed)
    root = fresh_dir(spark, "cube-test")
    r, c = spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(classes, CLASSES)
    got = cube_upkeep.maintain(spark, root, r, c, F.col("batch"), F.col("batch"), compact_every=4, dedupe=dedupe)
    want = expected(spark, reviews, classes, dedupe)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rerun_of_a_batch_changes_nothing(spark):
    reviews, classes = random_run(7, batches=3)
    root = fresh_dir(spark, "cube-test")
    r, c = spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(classes, CLASSES)
    cube_upkeep.maintain(spark, root, r, c, F.col("batch"), F.col("batch"), compact_every=10)
    # The job died after batch 1 wrote its facts: batch 1 is run again with the same number.
    cube_upkeep.apply_batch(spark, root, 1, r.where("batch = 1"), c.where("batch = 1"))
    got = cube_upkeep.current(spark, root)
    want = expected(spark, reviews, classes, None)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_relabel_gives_minus_and_plus(spark):
    root = fresh_dir(spark, "cube-test")
    day = datetime(1997, 2, 3, 10)
    r = spark.createDataFrame([("a", "Toys", "Q1", True, day, 0)], REVIEWS)
    c0 = spark.createDataFrame([("a", "Praise/Positive", "Positive", "Low", "x", day, 0)], CLASSES)
    c1 = spark.createDataFrame([("a", "Not As Described", "Negative", "High", "y", day + timedelta(days=1), 1)], CLASSES)
    cube_upkeep.apply_batch(spark, root, 0, r, c0, "latest")
    cube_upkeep.apply_batch(spark, root, 1, r.limit(0), c1, "latest")
    delta = {(x.feedback_category, x.n) for x in spark.read.parquet(f"{root}/delta/batch=1").collect()}
    assert delta == {("Praise/Positive", -1), ("Not As Described", 1)}


def test_batch_reads_only_its_buckets(spark):
    reviews, classes = random_run(9, batches=2)
    root = fresh_dir(spark, "cube-test")
    r, c = spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(classes, CLASSES)
    cube_upkeep.maintain(spark, root, r, c, F.col("batch"), F.col("batch"))
    plan = cube_upkeep.batch_delta(spark, root, 1)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().lower()
    assert "dynamicpruning" in text and "batch#" in text
