"""The registered queries: every operator over the whole test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.times import epoch_ms_to_ts
from voc_spark.operators import (
    chat, classify, constraints, counts, filters, ingest, joins, prep, profile, questions, sampling, specs, windows,
)
from voc_spark.plans import answers, cube_upkeep, summaries
from voc_spark.schemas import RAW_REVIEWS, SUMMARIES, TABLES
from voc_spark.session import fresh_dir
from voc_spark.sources import demo_tables as demo
from voc_spark.sources.parquet import init_tables as init_empty
from voc_spark.sources.parquet import read_version, scan_reviews, write_table
from voc_spark.streaming import ingest_classify

Query = Callable[[SparkSession, str], DataFrame]

LOOKUP_ID = "7_31"
SPEC_LIST = [
    {"spec_id": 1, "sentiment": "Negative"},
    {"spec_id": 2, "product_category": "ECONOMY", "urgency": "High"},
    {"spec_id": 3, "feedback_category": "Praise/Positive", "sentiment": "Positive"},
    {"spec_id": 4},
    {"spec_id": 5, "product_category": "Unknown"},
    {"spec_id": 6, "verified_purchase": False, "date_start": "1997-01-01", "date_end": "1997-06-30"},
]
QUESTIONS = [
    {"spec_id": 1, "query_type": "count", "sentiment": "Negative", "date_start": "1997-01-01", "date_end": "1997-06-30", "explanation": "negative in H1"},
    {"spec_id": 2, "query_type": "breakdown", "breakdown_column": "feedback_category", "product_category": "ECONOMY", "explanation": "by category"},
    {"spec_id": 3, "query_type": "chart", "group_by_column": "urgency", "chart_types": ["line", "pie"], "explanation": "urgency chart"},
    {"spec_id": 4, "query_type": "chart", "group_by_column": "quarter", "product_category": "Unknown", "explanation": "no rows"},
    {"spec_id": 5, "query_type": "breakdown", "breakdown_column": "rating", "explanation": "bad column"},
    {"spec_id": 6, "query_type": "lookup", "review_id": "no_such_review", "explanation": "find it"},
    {"spec_id": 7, "query_type": "unsupported", "explanation": "cannot be answered"},
    {"spec_id": 8, "query_type": "summary", "date_start": "1997-01-01", "date_end": "1997-06-30", "explanation": "how was H1"},
    {"spec_id": 9, "query_type": "count", "date_start": "1997-01-01", "date_end": "June", "explanation": "bad date"},
]


def _view(spark: SparkSession, d: str, **options) -> DataFrame:
    return joins.counting_view(demo.reviews(spark, d), demo.classifications(spark, d), **options)


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return joins.feedback_view(demo.reviews(spark, d), demo.classifications(spark, d))


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    raw = demo.raw_reviews(spark, d)
    return prep.windowed_reviews(raw, *demo.WINDOW, demo.Q1_END, labels=("Q1", "Q2"))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    sample = sampling.stratified_sample(
        _windowed(spark, d), 200, 42, ("asin", "user_id", "timestamp", "l_orderkey", "l_linenumber"), on_short="take_all"
    )
    return sample.withColumn("review_id", prep.review_key())


def _all_windows(spark: SparkSession, d: str) -> DataFrame:
    return demo.windows(spark).unionByName(demo.order_windows(spark, d))


def _keyed_raw(spark: SparkSession, d: str) -> DataFrame:
    return demo.raw_reviews(spark, d).withColumn("review_id", prep.review_key())


LABELS = ["review_id", "product_category", "feedback_category", "sentiment", "urgency"]
SAMPLE_COLUMNS = [
    "review_id", "asin", "user_id", "product_category", "product_title", "text", "rating", "timestamp", "review_date", "quarter",
    "verified_purchase", "l_orderkey", "l_linenumber",
]


# --- sources and sinks -----------------------------------------------------
def scan_reviews_parquet(spark, d):
    return scan_reviews(spark, demo.table_path(spark, d, "raw_reviews"), RAW_REVIEWS)


def sink_sample_parquet(spark, d):
    return write_table(_sample(spark, d).select(*SAMPLE_COLUMNS), fresh_dir(spark, "sample"))


def ingest_project(spark, d):
    raw = prep.with_review_date(_keyed_raw(spark, d))
    return ingest.ingest_project(raw.withColumn("quarter", prep.quarter_label(F.col("review_date"), demo.Q1_END, "Q1", "Q2")))


def review_key(spark, d):
    return demo.raw_reviews(spark, d).select("l_orderkey", "l_linenumber", prep.review_key().alias("review_id"))


def insert_if_absent(spark, d):
    target = demo.reviews(spark, d).where("quarter = 'Q1'")
    fresh = ingest.insert_if_absent(
        _keyed_raw(spark, d), target, order=["timestamp", "l_orderkey", "l_linenumber", "l_extendedprice"]
    )
    return fresh.select(
        "review_id", "product_category", "product_title", "text", "rating", "timestamp", "verified_purchase", "l_orderkey", "l_linenumber")


def append_classification(spark, d):
    return ingest.append_classification(demo.classifications(spark, d), demo.reviews(spark, d))


def init_tables(spark, d):
    """Empty tables, filled from the stored reviews and labels, and audited by their own rules."""
    paths = init_empty(spark, fresh_dir(spark, "tables"))
    ingest.stamp_ingested(demo.reviews(spark, d)).write.mode("append").parquet(paths["reviews"])
    demo.classifications(spark, d).write.mode("append").parquet(paths["classifications"])
    found = None
    for name, schema in TABLES.items():
        part = constraints.audit_table(spark.read.schema(schema).parquet(paths[name]), name).select(F.lit(name).alias("table"), "rule", "violations")
        found = part if found is None else found.unionByName(part)
    return found


def _stored_summaries(spark, d):
    """A summaries table with one stored version: the report windows and one window per order."""
    root = fresh_dir(spark, "summaries")
    summaries.run_summaries(spark, root, demo.reviews(spark, d), demo.classifications(spark, d), _all_windows(spark, d), view=demo.cube(spark, d))
    return root


SUMMARY_COLUMNS = ["window_label", "date_start", "date_end", "total_reviews", "stats", "narrative"]


def _shown(df: DataFrame) -> DataFrame:
    days = {c: F.col(c).cast("string") for c in ("date_start", "date_end")}
    return df.withColumns(days).select(*SUMMARY_COLUMNS, F.col("generated_at").isNotNull().alias("stamped"))


def upsert_summary(spark, d):
    """A second version over the first: part of the labels again, each twice; the row with more reviews wins."""
    root = _stored_summaries(spark, d)
    again = read_version(spark, root, SUMMARIES).where("window_label < 'w3'").select(*SUMMARY_COLUMNS)
    twice = again.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    revised = twice.withColumn("total_reviews", F.col("total_reviews") + F.col("k")).withColumn("narrative", F.concat(F.lit("revised "), F.col("k"))).drop("k")
    ingest.upsert_summaries(spark, root, revised)
    return _shown(read_version(spark, root, SUMMARIES))


def get_stored_summary(spark, d):
    return _shown(ingest.stored_summary(read_version(spark, _stored_summaries(spark, d), SUMMARIES), "Q2 1998"))


def table_preview(spark, d):
    return profile.table_preview(demo.reviews(spark, d).drop("review_ts"), "reviews", 20, 80, "review_id")


# --- preparation -----------------------------------------------------------
def epoch_ms_to_ts_query(spark, d):
    return demo.raw_reviews(spark, d).select("l_orderkey", "l_linenumber", epoch_ms_to_ts(F.col("timestamp")).alias("review_date"))


def window_filter(spark, d):
    return prep.with_review_date(prep.window_filter(demo.raw_reviews(spark, d), *demo.WINDOW)).select(
        "l_orderkey", "l_linenumber", "review_date"
    )


def quarter_label(spark, d):
    return _windowed(spark, d).select("l_orderkey", "l_linenumber", "review_date", "quarter")


def rating_band(spark, d):
    banded = _windowed(spark, d).withColumn("band", prep.rating_band(F.col("rating")))
    return banded.groupBy("product_category", F.coalesce("band", F.lit("dropped")).alias("band")).agg(F.count(F.lit(1)).alias("count"))


def stratified_sample(spark, d):
    return _sample(spark, d).select(*SAMPLE_COLUMNS)


def sample_profile(spark, d):
    return sampling.sample_profile(_sample(spark, d)).withColumn("value", F.round("value", 6))


# --- constraints -----------------------------------------------------------
def audit_not_null_unique(spark, d):
    raw = _keyed_raw(spark, d).join(demo.reviews(spark, d).select("review_id", "review_date"), "review_id")
    return constraints.audit_not_null_unique(raw, ["product_category", "text", "review_date"], "review_id")


def orphan_classifications(spark, d):
    return constraints.orphan_classifications(demo.classifications(spark, d), demo.reviews(spark, d))


def validate_classification_json(spark, d):
    return constraints.validate_classification_json(demo.completions(spark, d)).drop("raw_json")


# --- filters ---------------------------------------------------------------
def filter_dimension_eq(spark, d):
    return filters.filter_dimensions(_joined(spark, d), product_category="PROMO", sentiment="Negative").select(*LABELS)


def filter_verified(spark, d):
    return filters.filter_verified(_joined(spark, d), False).select(*LABELS, "verified_purchase")


def filter_date_between(spark, d):
    return filters.filter_dates(_joined(spark, d), *demo.WINDOW).select(*LABELS, "review_date")


def filter_multi_select(spark, d):
    return filters.filter_multi_select(
        _joined(spark, d), product_category=["ECONOMY", "LARGE"], sentiment=["Negative", "Neutral"], urgency=[]
    ).select(*LABELS)


def date_range_overlap(spark, d):
    return windows.date_range_overlap(_all_windows(spark, d), demo.reviews(spark, d))


def lookup_review(spark, d):
    spec = {"query_type": "lookup", "review_id": LOOKUP_ID, "explanation": "lookup"}
    return answers.run_spec(demo.reviews(spark, d), demo.classifications(spark, d), spec).drop("note", "chart_types")


# --- joins -----------------------------------------------------------------
def feedback_view(spark, d):
    return _joined(spark, d)


def latest_reviews(spark, d):
    return joins.latest_reviews(demo.reviews(spark, d), demo.classifications(spark, d), 1500)


def pending_reviews(spark, d):
    return joins.pending_reviews(demo.reviews(spark, d), demo.classifications(spark, d)).select("review_id", "review_text")


def latest_classification(spark, d):
    return joins.latest_classification(demo.classifications(spark, d))


def batch_specs_count(spark, d):
    return specs.count_specs(demo.cube(spark, d), demo.spec_requests(spark, d))


def spec_list_count(spark, d):
    return specs.count_spec_list(_view(spark, d), SPEC_LIST)


def window_stats_many(spark, d):
    return windows.window_counts(demo.cube(spark, d), _all_windows(spark, d))


# --- aggregates ------------------------------------------------------------
def count_query(spark, d):
    return counts.count_query(_view(spark, d), sentiment="Negative", verified_purchase=True, date_start="1997-01-01", date_end="1999-12-31")


def count_query_latest(spark, d):
    return counts.count_query(_view(spark, d, dedupe="latest"), sentiment="Negative")


def breakdown_query(spark, d):
    return counts.breakdown_query(_view(spark, d), "sentiment", product_category="ECONOMY")


def chart_query(spark, d):
    return counts.chart_query(_view(spark, d), "feedback_category", date_start="1997-01-01", date_end="1997-06-30")


def aggregated_stats(spark, d):
    return counts.aggregated_stats(_view(spark, d), sentiment="Negative")


def drilldown_rows(spark, d):
    return counts.filtered_rows(_joined(spark, d), sentiment="Negative", urgency="High")


def top_themes(spark, d):
    return counts.top_themes(_view(spark, d), 5, sentiment="Negative")


def window_stats(spark, d):
    return counts.window_stats(_view(spark, d), *demo.WINDOW)


def dashboard_charts(spark, d):
    return counts.dashboard_charts(filters.filter_multi_select(_view(spark, d), urgency=["High", "Low"]))


def coverage(spark, d):
    return profile.coverage(demo.reviews(spark, d))


def distinct_values(spark, d):
    return profile.distinct_values(demo.reviews(spark, d), demo.classifications(spark, d))


def schema_profile(spark, d):
    return profile.schema_profile(demo.reviews(spark, d), demo.classifications(spark, d))


def feedback_cube(spark, d):
    return counts.feedback_cube(_view(spark, d)).withColumn("review_day", F.col("review_day").cast("string"))


def feedback_cube_maintained(spark, d):
    """The cube built by yearly batches of reviews and labels in order of arrival, with signed deltas and compaction."""
    reviews, classes = demo.reviews(spark, d), demo.classifications(spark, d)
    kept = cube_upkeep.maintain(spark, fresh_dir(spark, "cube-upkeep"), reviews, classes, F.year("review_ts"), F.year("classified_at"))
    return kept.withColumn("review_day", F.col("review_day").cast("string"))


# --- specs -----------------------------------------------------------------
def normalize_specs(spark, d):
    return specs.normalize_specs(demo.spec_requests(spark, d), demo.reviews(spark, d)).select(
        "spec_id", "query_type", "date_start", "date_end", "explanation"
    )


def validate_specs(spark, d):
    known = profile.distinct_values(demo.reviews(spark, d), demo.classifications(spark, d))
    return specs.validate_specs(demo.spec_requests(spark, d), known)


def normalize_chart_types(spark, d):
    return specs.normalize_chart_types(demo.spec_requests(spark, d)).select(
        "spec_id", F.array_join("chart_types", ",").alias("chart_types"), "note"
    )


def run_spec(spark, d):
    return answers.run_specs(demo.reviews(spark, d), demo.classifications(spark, d), QUESTIONS).withColumn("chart_types", F.array_join("chart_types", ","))


# --- text, labels, narratives ----------------------------------------------
def classify_rules(spark, d):
    return classify.classify_rules(demo.text_reviews(spark, d)).select("review_id", *classify.FIELDS)


def classify_rules_reviews(spark, d):
    return classify.classify_rules(demo.reviews(spark, d)).select("review_id", *classify.FIELDS)


class DemoModel:
    """A stand-in for a model client: its answer depends on the text length, and some calls fail."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def __call__(self, texts: list[str]) -> list[str | None]:
        return [self.answer(t) for t in texts]

    def answer(self, text: str) -> str | None:
        kind, first_time = len(text) % 7, text not in self.seen
        self.seen.add(text)
        if kind == 1 and first_time:
            return None
        if kind == 5:
            raise ConnectionError("no answer to this text")
        if kind == 0:
            return '{"feedback_category": "Not As'
        category = {2: "No such category", 3: tx.COMPLAINTS[0], 4: tx.PRAISE}.get(kind, tx.NO_CONTEXT)
        return f'{{"feedback_category": "{category}", "sentiment": "Neutral", "urgency": "Low", "reasoning": "kind {kind}"}}'


def classify_model(spark, d):
    return classify.classify_model(demo.text_reviews(spark, d), DemoModel, sleep=float)


def build_prompts(spark, d):
    prompts = classify.build_prompts(demo.text_reviews(spark, d))
    part = lambda m: F.concat_ws("~", *[m[f] for f in classify.MESSAGE])
    return prompts.select(
        "review_id", F.size("messages").alias("n_messages"),
        F.md5(F.array_join(F.transform("messages", part), "|")).alias("prompt_md5"),
        F.length(F.element_at("messages", -1)["content"]).alias("question_chars"),
    )


def classification_agreement(spark, d):
    texts = demo.text_reviews(spark, d)
    gold = texts.select("review_id", F.col("gold_category").alias("feedback_category"))
    return classify.classification_agreement(classify.classify_rules(texts), gold)


def reprocess_queue(spark, d):
    failed = (F.col("reasoning") == "rule") & (F.substring(F.md5("review_id"), 1, 1) == "0")
    marked = demo.classifications(spark, d).withColumn("reasoning", F.when(failed, tx.FALLBACK["reasoning"]).otherwise(F.col("reasoning")))
    return joins.reprocess_queue(marked, tx.FALLBACK["reasoning"])


def window_narrative(spark, d):
    profiles = windows.window_profiles(demo.cube(spark, d), _all_windows(spark, d))
    return windows.with_narrative(profiles.where("total_reviews > 0")).select("window_label", "narrative")


def window_summary_job(spark, d):
    return summaries.window_summaries(
        demo.reviews(spark, d), demo.classifications(spark, d), _all_windows(spark, d), view=demo.cube(spark, d))


def stats_json(spark, d):
    profiles = windows.window_profiles(demo.cube(spark, d), _all_windows(spark, d)).where("total_reviews > 0")
    return windows.parse_stats(profiles.select("window_label", windows.stats_json().alias("stats")))


def newest_first_thread(spark, d):
    return chat.newest_first_thread(demo.source(spark, d, "conversations"))


def context_window(spark, d):
    return chat.context_window(demo.source(spark, d, "conversations"), 3)


def parse_spec_json(spark, d):
    parsed = questions.parse_spec_json(demo.spec_answers(spark, d)).drop("raw_json")
    return parsed.withColumn("chart_types", F.array_join("chart_types", ","))


def query_prompts(spark, d):
    schema = profile.coverage(demo.reviews(spark, d)).select(F.concat(F.lit("rows "), F.col("row_count").cast("string")).alias("s")).scalar()
    prompts = questions.query_prompts(demo.source(spark, d, "conversations"), schema)
    return prompts.select("conv_id", F.size("messages").alias("n_messages"), F.md5(_joined_messages()).alias("prompt_md5"))


def _joined_messages():
    return F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("~"), m["content"])), "|")


def summary_prompts(spark, d):
    profiles = windows.window_profiles(demo.cube(spark, d), _all_windows(spark, d))
    asked = questions.summary_prompts(profiles).select("window_label", F.lit("summary").alias("task"), "messages")
    done = summaries.window_summaries(demo.reviews(spark, d), demo.classifications(spark, d), _all_windows(spark, d), view=demo.cube(spark, d))
    more = questions.followup_prompts(done.where("success")).select("window_label", F.lit("followups").alias("task"), "messages")
    return asked.unionByName(more).select("window_label", "task", F.md5(_joined_messages()).alias("prompt_md5"))


def parse_followups(spark, d):
    return chat.parse_followups(demo.followup_texts(spark, d))


def stream_ingest_classify(spark, d):
    root = fresh_dir(spark, "stream")
    source = demo.table_path(spark, d, "raw_reviews")
    schema = spark.read.parquet(source).schema

    def prepare(raw: DataFrame) -> DataFrame:
        dated = prep.with_review_date(raw.withColumn("review_id", prep.review_key()))
        return dated.withColumn("quarter", prep.quarter_label(F.col("review_date"), demo.Q1_END, "Q1", "Q2"))

    ingest_classify.start_ingest_stateful(
        spark, source, schema, root, prepare, classify.classify_rules,
        ["timestamp", "l_orderkey", "l_linenumber", "l_extendedprice"], files_per_batch=4,
    ).awaitTermination()
    stored = ingest_classify.read_table(spark, root, "reviews").select("review_id", "product_category", "rating", "review_date", F.md5("review_text").alias("text_md5"))
    labels = ingest_classify.read_table(spark, root, "classifications").select(F.col("review_id").alias("labelled_id"), *classify.FIELDS)
    return stored.join(labels, stored["review_id"] == labels["labelled_id"], "full")


QUERIES: dict[str, Query] = {
    "scan_reviews_parquet": scan_reviews_parquet,
    "sink_sample_parquet": sink_sample_parquet,
    "ingest_project": ingest_project,
    "review_key": review_key,
    "insert_if_absent": insert_if_absent,
    "append_classification": append_classification,
    "upsert_summary": upsert_summary,
    "get_stored_summary": get_stored_summary,
    "init_tables": init_tables,
    "table_preview": table_preview,
    "epoch_ms_to_ts": epoch_ms_to_ts_query,
    "window_filter": window_filter,
    "quarter_label": quarter_label,
    "rating_band": rating_band,
    "stratified_sample": stratified_sample,
    "sample_profile": sample_profile,
    "audit_not_null_unique": audit_not_null_unique,
    "orphan_classifications": orphan_classifications,
    "validate_classification_json": validate_classification_json,
    "filter_dimension_eq": filter_dimension_eq,
    "filter_verified": filter_verified,
    "filter_date_between": filter_date_between,
    "filter_multi_select": filter_multi_select,
    "date_range_overlap": date_range_overlap,
    "lookup_review": lookup_review,
    "feedback_view": feedback_view,
    "latest_reviews": latest_reviews,
    "pending_reviews": pending_reviews,
    "latest_classification": latest_classification,
    "batch_specs_count": batch_specs_count,
    "spec_list_count": spec_list_count,
    "window_stats_many": window_stats_many,
    "count_query": count_query,
    "count_query_latest": count_query_latest,
    "breakdown_query": breakdown_query,
    "chart_query": chart_query,
    "aggregated_stats": aggregated_stats,
    "drilldown_rows": drilldown_rows,
    "top_themes": top_themes,
    "window_stats": window_stats,
    "dashboard_charts": dashboard_charts,
    "coverage": coverage,
    "distinct_values": distinct_values,
    "schema_profile": schema_profile,
    "feedback_cube": feedback_cube,
    "feedback_cube_maintained": feedback_cube_maintained,
    "newest_first_thread": newest_first_thread,
    "normalize_specs": normalize_specs,
    "validate_specs": validate_specs,
    "normalize_chart_types": normalize_chart_types,
    "run_spec": run_spec,
    "classify_rules": classify_rules,
    "classify_rules_reviews": classify_rules_reviews,
    "classify_model": classify_model,
    "build_prompts": build_prompts,
    "context_window": context_window,
    "reprocess_queue": reprocess_queue,
    "window_narrative": window_narrative,
    "window_summary_job": window_summary_job,
    "stats_json": stats_json,
    "parse_spec_json": parse_spec_json,
    "query_prompts": query_prompts,
    "summary_prompts": summary_prompts,
    "parse_followups": parse_followups,
    "classification_agreement": classification_agreement,
    "stream_ingest_classify": stream_ingest_classify,
}
