"""One query spec to one lazy answer frame.

Every answer has the columns (kind, explanation, position, label, value, note, chart_types): a count has one
row, a table or chart one per group, a looked-up review one per column, a message one with null label. A summary is
followed by its follow-up questions, one row each. Only charts have chart_types, and a note where a line was asked for.
"""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.times import is_plain_date
from voc_spark.operators.chat import followup_questions
from voc_spark.operators.counts import breakdown_query, chart_query, count_query
from voc_spark.operators.joins import counting_view, lookup_pairs
from voc_spark.operators.specs import chart_note, chart_types
from voc_spark.plans.summaries import label_windows, window_summaries
from voc_spark.functions.literal import literal_table

ANSWER = ["kind", "explanation", "position", "label", "value", "note", "chart_types"]


def _answer(df: DataFrame, kind: str, explanation: str | Column, position, label, value) -> DataFrame:
    text = F.lit(explanation).cast("string") if not isinstance(explanation, Column) else explanation
    as_text = lambda c: F.lit(c).cast("string") if not isinstance(c, Column) else c.cast("string")
    where = position if isinstance(position, Column) else F.lit(position)
    return df.select(
        F.lit(kind).alias("kind"), text.alias("explanation"), where.cast("int").alias("position"),
        as_text(label).alias("label"), as_text(value).alias("value"),
        F.lit(None).cast("string").alias("note"), F.lit(None).cast("array<string>").alias("chart_types"),
    )


def message(spark, text: str) -> DataFrame:
    return _answer(spark.range(1), "message", text, 0, None, None)


def _or_message(answer: DataFrame, text: str) -> DataFrame:
    """The answer, or one message row when it is empty.

    An answer has one row per group value or column, so counting it in one place is cheap.
    """
    rows = answer.withColumn("_real", F.lit(1)).unionByName(message(answer.sparkSession, text).withColumn("_real", F.lit(0)))
    found = F.sum("_real").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("_found", found).where("_real = 1 OR _found = 0").drop("_real", "_found")


def _count(reviews, classifications, spec):
    return _answer(count_query(counting_view(reviews, classifications), **spec), "count", spec["explanation"], 0, "count", F.col("count"))


def _rows(counted: DataFrame, column: str, kind: str, explanation: str | Column) -> DataFrame:
    # One row per distinct group value reaches this ranking.
    rank = F.row_number().over(Window.orderBy(F.desc("count"), column))
    return _answer(counted.withColumn("_r", rank), kind, explanation, F.col("_r"), F.col(column), F.col("count"))


def _breakdown(reviews, classifications, spec):
    column = spec.get("breakdown_column")
    if column not in tx.GROUP_COLUMNS:
        return message(reviews.sparkSession, tx.BAD_BREAKDOWN_FORMAT % column)
    filters = {k: v for k, v in spec.items() if k in tx.FILTER_DIMENSIONS}
    return _rows(breakdown_query(counting_view(reviews, classifications), column, **filters), column, "table", spec["explanation"])


def _chart(reviews, classifications, spec):
    column = spec.get("group_by_column")
    if column not in tx.GROUP_COLUMNS:
        return message(reviews.sparkSession, tx.BAD_CHART_FORMAT % column)
    filters = {k: v for k, v in spec.items() if k in (*tx.FILTER_DIMENSIONS, "date_start", "date_end")}
    wanted = F.array(*map(F.lit, spec.get("chart_types") or [])).cast("array<string>")
    rows = _rows(chart_query(counting_view(reviews, classifications), column, **filters), column, "chart", spec["explanation"])
    return _or_message(rows.withColumns({"note": chart_note(wanted), "chart_types": chart_types(wanted)}), tx.NO_MATCH)


def _lookup(reviews, classifications, spec):
    key = spec.get("review_id")
    pairs = lookup_pairs(reviews, classifications, key)
    rows = _answer(pairs, "keyvalue", spec["explanation"], F.col("position"), F.col("column"), F.col("value"))
    return _or_message(rows, tx.NOT_FOUND_FORMAT % key)


def _summary(reviews, classifications, spec):
    if not (spec.get("date_start") and spec.get("date_end")):
        return message(reviews.sparkSession, spec["explanation"])
    window = literal_table(
        reviews.sparkSession, {"date_start": "string", "date_end": "string"}, [(spec["date_start"], spec["date_end"])]
    )
    done = window_summaries(reviews, classifications, label_windows(window))
    ok = F.col("success")
    entry = lambda kind, at, label, value: F.struct(
        F.lit(kind).alias("kind"), F.lit(spec["explanation"]).alias("explanation"), at.cast("int").alias("position"), label.cast("string").alias("label"), value.alias("value"))
    questions = F.transform(followup_questions(F.lit(None).cast("string")), lambda q, i: entry("followup", i + 1, i + 1, q))
    answer = F.concat(F.array(entry("summary", F.lit(0), F.col("window_label"), F.col("narrative"))), questions)
    failed = F.array(F.struct(F.lit("message").alias("kind"), F.col("error").alias("explanation"), F.lit(0).alias("position"),
                              F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("value")))
    return done.select(F.inline(F.when(ok, answer).otherwise(failed))).select(
        "*", F.lit(None).cast("string").alias("note"), F.lit(None).cast("array<string>").alias("chart_types"))


ROUTES: Mapping[str, Callable[[DataFrame, DataFrame, dict], DataFrame]] = {
    "count": _count, "breakdown": _breakdown, "chart": _chart, "lookup": _lookup, "summary": _summary,
}


def run_spec(reviews: DataFrame, classifications: DataFrame, spec: dict) -> DataFrame:
    """Answer one spec; an unknown query type gives its explanation as a message, dates that are none say so."""
    start, end = spec.get("date_start"), spec.get("date_end")
    if start and end and not (is_plain_date(start) and is_plain_date(end)):
        return message(reviews.sparkSession, tx.BAD_DATES_FORMAT % (start, end))
    route = ROUTES.get(spec["query_type"])
    return route(reviews, classifications, spec) if route else message(reviews.sparkSession, spec["explanation"])


def run_specs(reviews: DataFrame, classifications: DataFrame, specs: list[dict]) -> DataFrame:
    """The answers to a short list of questions in one frame, told apart by spec_id."""
    answers = [run_spec(reviews, classifications, s).select(F.lit(s["spec_id"]).alias("spec_id"), *ANSWER) for s in specs]
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out
