"""Review tables derived from the star-schema test tables.

`raw_reviews`, `reviews` and `classifications` are written once per application and data
folder, as the stored tables that every query reads. `text_reviews`, `spec_requests`,
`completions` and `followup_texts` are plain projections and stay lazy.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voc_spark.functions.literal import literal_table
from voc_spark.functions.times import epoch_ms_to_ts, ntz, ts_to_epoch_ms
from voc_spark.operators.counts import feedback_cube
from voc_spark.operators.joins import counting_view
from voc_spark.operators.prep import review_key
from voc_spark.session import shared_dir
from voc_spark.sources.parquet import ID_LOOKUP, scratch, stored
from voc_spark.taxonomy import FEEDBACK_CATEGORIES

Q1_END = "1997-03-31"
WINDOW = ("1997-01-01", "1997-06-30")

# --- Fixed values: opening phrases by number mod 12 -------------------------
PHRASES = [
    "This broke after one use",
    "Wrong size and nothing like the photos",
    "Delivery was late",
    "Overpriced and not worth it",
    "Hard to use and slow",
    "The seller refused my refund",
    "Love it, great and perfect",
    "sad",
    "It is unusable, never buy",
    "Sort of disappointed, too short",
    "ok",
    "Great but the quality is poor",
]
# The category each phrase was written for.
PHRASE_CATEGORY = [FEEDBACK_CATEGORIES[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 7, 4, 7, 0)]

# --- Fixed values: report windows -------------------------------------------
WINDOWS = [
    ("H1 1997", "1997-01-01", "1997-06-30"),
    ("Q2 1998", "1998-04-01", "1998-06-30"),
    ("before", "1990-01-01", "1990-12-31"),
    ("reversed", "1999-06-30", "1999-01-01"),
    ("partial", "2001-10-01", "2003-01-01"),
]


def by_number(number: Column, values: list[str]) -> Column:
    """Pick values[number mod len]."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Columns of a raw review that come from the line item and its order, and from its part.
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate"]
PART_COLUMNS = ["p_partkey", "p_type", "p_name"]
RAW_ORDER = ["timestamp", "l_orderkey", "l_linenumber", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Line items of the given orders with the customer, as stored; what follows from these columns is derived after the shuffles."""
    items = source(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(*LINE_COLUMNS, "o_custkey")


def _raw_timestamp() -> Column:
    offset = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 3571) % 86400
    return ts_to_epoch_ms(F.timestamp_add("SECOND", offset.cast("int"), F.col("l_shipdate").cast("timestamp_ntz")))


def _raw(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("p_partkey").cast("string").alias("asin"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("p_type").alias("product_category"),
        F.col("p_name").alias("product_title"),
        (1 + F.col("l_quantity").cast("int") % 9 * 0.5).cast("double").alias("rating"),
        _raw_timestamp().alias("timestamp"),
        (F.col("l_linestatus") == "F").alias("verified_purchase"),
        F.concat(by_number(F.col("l_orderkey"), PHRASES), F.lit(" "), "p_name").alias("text"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


def _build_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    parts = source(spark, sf_dir, "part").select(*PART_COLUMNS)
    return _raw(lines.join(parts, lines.l_partkey == parts.p_partkey))


def _build_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First raw review of every key, found on the line items before their texts exist.

    A key is a part and a customer. Line items are clustered by part once, which serves the choice per key and the join
    with the part: the texts are in no shuffle. Without a customer there is no key, and of all such rows one is kept.
    """
    orders = source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = source(spark, sf_dir, "part").select(*PART_COLUMNS)
    lines = _lines(spark, sf_dir, orders.where("o_custkey IS NOT NULL")).where("l_partkey IS NOT NULL").repartition("l_partkey")
    first = Window.partitionBy("l_partkey", "o_custkey").orderBy(*RAW_ORDER)
    kept = lines.withColumn("timestamp", _raw_timestamp()).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "timestamp")
    one_each = parts.groupBy("p_partkey").agg(F.min(F.struct("p_type", "p_name")).alias("p")).select("p_partkey", "p.*")
    keyed = _raw(kept.join(one_each, kept.l_partkey == one_each.p_partkey))
    # Stored for its size: usually few or none, so the line items are not shuffled for them.
    nobody = _lines(spark, sf_dir, stored(orders.where("o_custkey IS NULL"), "orders-no-customer"))
    keyless = _raw(nobody.join(parts, nobody.l_partkey == parts.p_partkey)).orderBy(*RAW_ORDER).limit(1)
    ts = epoch_ms_to_ts(F.col("timestamp"))
    return (
        keyed.unionByName(keyless)
        .select(
            review_key().alias("review_id"), "product_category", "product_title", F.col("text").alias("review_text"), "rating",
            ts.alias("review_ts"),
            F.when(F.col("l_orderkey") % 997 != 0, ts).alias("review_date"),
            F.when(ts <= ntz(Q1_END), "Q1").otherwise("Q2").alias("quarter"),
            "verified_purchase", "l_orderkey", "l_linenumber",
        )
        .sortWithinPartitions("review_date")
    )


def _build_classifications(reviews: DataFrame) -> DataFrame:
    key, line, ts = F.col("l_orderkey"), F.col("l_linenumber"), F.col("review_ts")

    def rows(when, review_id, category, sentiment, urgency, reasoning, days):
        return reviews.where(when).select(
            review_id.alias("review_id"), category.alias("feedback_category"), sentiment.alias("sentiment"),
            urgency.alias("urgency"), F.lit(reasoning).alias("reasoning"),
            F.timestamp_add("DAY", F.lit(days), ts).alias("classified_at"),
        )

    second = (F.lit("Not As Described"), F.lit("Negative"), F.lit("High"))
    first_pass = rows(
        key % 10 != 0, F.col("review_id"), by_number(key + line, FEEDBACK_CATEGORIES),
        by_number(key + 2 * line, ["Positive", "Neutral", "Negative"]),
        by_number(key, ["High", "Medium", "Low", "Low"]), "rule", 1,
    )
    return (
        first_pass
        .unionByName(rows(key % 50 == 1, F.col("review_id"), *second, "second pass", 2))
        .unionByName(rows(key % 1999 == 1, F.concat(F.lit("orphan_"), "review_id"), *second, "orphan", 1))
    )


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of the stored table, built first if this application has not done so."""
    tag = f"{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"
    path = f"{shared_dir(spark)}/voc-tables/{tag}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        with scratch(spark):
            BUILDERS[name](spark, sf_dir).write.mode("overwrite").options(**ID_LOOKUP, compression="zstd").parquet(path)
    return path


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw review per line item, duplicate keys included."""
    return spark.read.parquet(table_path(spark, sf_dir, "raw_reviews"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First raw review of every key."""
    return spark.read.parquet(table_path(spark, sf_dir, "reviews"))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for nine in ten reviews, some twice, plus a few without a review."""
    return spark.read.parquet(table_path(spark, sf_dir, "classifications"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feedback cube that window and spec queries count from."""
    return spark.read.parquet(table_path(spark, sf_dir, "feedback_cube"))


BUILDERS = {
    "raw_reviews": _build_raw,
    "reviews": _build_reviews,
    "classifications": lambda spark, sf_dir: _build_classifications(reviews(spark, sf_dir)),
    "feedback_cube": lambda spark, sf_dir: feedback_cube(counting_view(reviews(spark, sf_dir), classifications(spark, sf_dir))),
}


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as reviews, each opened by a phrase of known category."""
    docs = source(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("product_category"),
        F.concat(by_number(F.col("doc_id"), PHRASES), F.lit(" "), "text").alias("review_text"),
        "lang", "doc_id", by_number(F.col("doc_id"), PHRASE_CATEGORY).alias("gold_category"),
    )


def windows(spark: SparkSession) -> DataFrame:
    """The fixed report windows, as one small table."""
    return literal_table(spark, {"window_label": "string", "date_start": "string", "date_end": "string"}, WINDOWS)


def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window per order, so the window table grows with the data; some hold no date, or one with a time of day."""
    start, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    day = start.cast("string")
    return source(spark, sf_dir, "orders").select(
        F.concat(F.lit("w"), "o_orderkey").alias("window_label"),
        F.when(k % 89 == 0, "1997-13-01").when(k % 97 == 0, F.concat(day, F.lit(" 12:00:00"))).otherwise(day).alias("date_start"),
        F.date_add(start, (F.col("o_custkey") % 120 - 10).cast("int")).cast("string").alias("date_end"),
    )


def spec_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query spec per order: mixed types, filters, wrong values, reversed and outlying dates."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")

    def pick(modulus: int, values: list) -> Column:
        return by_number(F.floor(k / modulus), values)

    start = F.when(k % 7 == 0, F.date_add(day, 60)).when(k % 11 == 0, F.date_add(day, -4000)).otherwise(day)
    end = F.when(k % 13 == 0, F.date_add(day, 4000)).otherwise(F.date_add(day, (k % 50).cast("int")))
    return source(spark, sf_dir, "orders").select(
        k.alias("spec_id"),
        by_number(k, ["count", "breakdown", "chart", "summary"]).alias("query_type"),
        F.when(k % 4 == 1, pick(4, ["sentiment", "quarter", "rating", "product_category"])).alias("breakdown_column"),
        F.when(k % 4 == 2, pick(4, ["urgency", "asin", "verified_purchase"])).alias("group_by_column"),
        F.when(k % 3 == 0, pick(3, ["ECONOMY", "PROMO", "Unknown", "LARGE"])).alias("product_category"),
        F.when(k % 5 == 0, pick(5, ["Praise/Positive", "Not As Described", "Other"])).alias("feedback_category"),
        F.when(k % 2 == 0, pick(2, ["Negative", "Positive", "Mixed"])).alias("sentiment"),
        F.when(k % 8 == 3, pick(8, ["High", "Low", "Urgent"])).alias("urgency"),
        F.when(k % 9 == 0, F.floor(k / 9) % 2 == 0).alias("verified_purchase"),
        F.when(k % 83 == 0, "soon").when(k % 79 == 0, F.concat(start.cast("string"), F.lit(" 12:00"))).when(k % 17 != 0, start.cast("string")).alias("date_start"),
        F.when(k % 19 != 0, end.cast("string")).alias("date_end"),
        F.concat(F.lit("request "), k).alias("explanation"),
        F.split(pick(1, ["bar", "line,bar", "pie,pie", "line,line,pie", "scatter", "bar,radar,bar", ""]), ",").alias("chart_types"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer for every review, four in six damaged in a known way."""
    rows = reviews(spark, sf_dir)
    key = F.col("l_orderkey") + F.col("l_linenumber")
    category = by_number(key, FEEDBACK_CATEGORIES)
    good = F.format_string(
        '{"feedback_category": "%s", "sentiment": "Negative", "urgency": "Low", "reasoning": "says %s"}',
        category, F.col("product_title"),
    )
    kinds = [
        good,
        F.format_string('{"feedback_category": "%s", "sentiment": "Negative", "urgency": "Low"}', category),
        F.lit('{"feedback_category": "Other", "sentiment": "Negative", "urgency": "Low", "reasoning": "x"}'),
        F.format_string('{"feedback_category": "%s", "sentiment": "Negative", "urgency": "Low", "reasoning": 5}', category),
        F.format_string('{"feedback_category": "%s", "sentiment"', category),
        F.format_string(
            '{"feedback_category": "%s", "sentiment": "Neutral", "urgency": "High", "reasoning": "ok", "extra": [1]}',
            category,
        ),
    ]
    raw = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        raw = F.when(F.col("l_orderkey") % len(kinds) == i, kind).otherwise(raw)
    return rows.select("review_id", raw.alias("raw_json"))


def spec_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer to every spec request as JSON, some damaged in a known way."""
    rows = spec_requests(spark, sf_dir)
    k = F.col("spec_id")
    names = [c for c in rows.columns if c != "spec_id"]
    good = F.to_json(F.struct(*names))
    raw = (
        F.when(k % 10 == 6, F.substring(good, 1, 20)).when(k % 10 == 7, F.to_json(F.struct(*[c for c in names if c != "explanation"])))
        .when(k % 10 == 8, F.lit('{"query_type": "guess", "explanation": "x"}')).when(k % 10 == 9, F.lit('{"query_type": "count", "sentiment": 5, "explanation": "typed"}'))
        .otherwise(good)
    )
    return rows.select("spec_id", raw.alias("raw_json"))


def followup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follow-up completion per document; some miss, some hold a dash-only line."""
    docs = source(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("- About "), "source", F.lit("?\n\n"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("-\n")).otherwise(F.lit("-- What next \n")),
        F.lit("1. In "), "lang", F.lit("\n"), "text",
    )
    return docs.select("doc_id", F.when(F.col("doc_id") % 5 != 4, text).alias("completion"))
