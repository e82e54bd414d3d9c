"""The whole batch path: raw files, sample, ingest, labels, answers, summaries."""

from pyspark.sql import functions as F

from tests.conftest import rows
from voc_spark import schemas
from voc_spark.functions.times import epoch_ms
from voc_spark.operators import classify, constraints, counts, joins, prep, profile, sampling, specs
from voc_spark.plans import answers, ingest_jobs, summaries
from voc_spark.session import fresh_dir
from voc_spark.sources import parquet

TEXTS = ["It broke at once", "Late delivery", "Love it", "sad", "Overpriced"]


def raw(spark, category):
    return spark.range(300).select(
        (F.lit(epoch_ms("2022-01-01")) + F.col("id") * 70_000_000).alias("timestamp"),
        (F.col("id") % 5 + 1).cast("double").alias("rating"), F.concat(F.lit("p"), F.col("id") % 40).alias("asin"),
        F.concat(F.lit("u"), F.col("id") % 290).alias("user_id"), F.lit(category).alias("product_category"),
        F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % 5 + 1).cast("int")).alias("text"),
        F.lit(category + " thing").alias("product_title"), (F.col("id") % 2 == 0).alias("verified_purchase"),
    )


def test_from_raw_files_to_answers(spark):
    root = fresh_dir(spark, "app")
    categories = ["Electronics", "Amazon_Fashion"]
    for c in categories:
        raw(spark, c).write.parquet(f"{root}/{c}.parquet")
    scanned = parquet.scan_reviews(spark, parquet.category_files(root, categories))
    sample = sampling.stratified_sample(prep.windowed_reviews(scanned), 60).withColumn("review_id", prep.review_key())
    sample = parquet.write_table(sample, f"{root}/sample")
    assert sample.count() == 120 and {q for q, in rows(sample.select("quarter").distinct())} == {"Q1 2022", "Q2 2022"}

    paths = parquet.init_tables(spark, f"{root}/tables")
    from voc_spark.operators.ingest import ingest_project

    keys = sample.select("review_id").distinct().count()
    report = ingest_jobs.ingest_reviews(spark, paths["reviews"], ingest_project(sample)).first()
    assert (report.attempted, report.inserted, report.skipped) == (120, keys, 120 - keys)
    again = ingest_jobs.ingest_reviews(spark, paths["reviews"], ingest_project(sample)).first()
    assert again.inserted == 0

    for _ in range(2):
        ingest_jobs.classify_pending(spark, paths["reviews"], paths["classifications"], classify.classify_rules)
    reviews = spark.read.schema(schemas.REVIEWS).parquet(paths["reviews"])
    labels = spark.read.schema(schemas.CLASSIFICATIONS).parquet(paths["classifications"])
    assert labels.count() == keys and joins.pending_reviews(reviews, labels).count() == 0
    for name, table in (("reviews", reviews), ("classifications", labels)):
        assert {v for _, v in rows(constraints.audit_table(table, name))} == {0}

    view = joins.counting_view(reviews, labels)
    spec = {"query_type": "count", "sentiment": "Positive", "explanation": "happy"}
    happy = counts.count_query(view, sentiment="Positive").first()[0]
    assert answers.run_spec(reviews, labels, spec).first().value == str(happy)
    version = summaries.run_summaries(
        spark, f"{root}/summaries", reviews, labels, spark.createDataFrame([("2022-01-01", "2022-06-30")], "date_start string, date_end string"))
    stored = parquet.read_version(spark, f"{root}/summaries", schemas.SUMMARIES, version).first()
    assert stored.total_reviews == keys and "Love" not in stored.narrative

    table = specs.spec_table(spark, [spec, {"query_type": "chart", "group_by_column": "rating", "sentiment": "Odd", "explanation": "x"},
                                     {"query_type": "poem", "explanation": "x"}])
    problems = sorted(rows(specs.validate_specs(table, profile.distinct_values(reviews, labels))))
    assert [i for i, _ in problems] == [1, 1, 2]
