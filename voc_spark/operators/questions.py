"""Questions in plain words: prompts for a model that turns them into specs, and its answers as spec rows."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from voc_spark import taxonomy as tx
from voc_spark.operators.chat import context_window
from voc_spark.operators.windows import STAT_KEYS
from voc_spark.schemas import QUERY_SPECS

# Our own wording of the three tasks; pass another text where needed.
PARSE_PROMPT = """Turn the question about customer feedback into one call of parse_query.
Use only columns and values listed in the schema. Dates are YYYY-MM-DD, the earlier one first.
Say unsupported, and why, if the columns cannot answer it."""
SUMMARY_PROMPT = """Write four to six sentences for product leads about these feedback counts: the main themes with their numbers,
the product category that stands out, urgent problems, and one step to take."""
FOLLOWUP_PROMPT = """Suggest three short questions that follow from this summary and can be answered from the same counts, one per line."""


def parse_spec_json(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Adds the 13 spec fields and `problem`, null for a readable answer.

    query_type and explanation must be strings, the type one of the known six. Other fields of a wrong type count
    as absent. An unreadable answer becomes an unsupported spec with the fixed sentence.
    """
    parsed = df.withColumn("_v", F.try_parse_json(raw))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))

    def typed(name: str, sql_type: str, variant: str) -> Column:
        field = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(field).startswith(variant), F.try_variant_get("_v", f"$.{name}", sql_type))

    values = {}
    for field in QUERY_SPECS.fields:
        kind = {T.ArrayType: "ARRAY", T.BooleanType: "BOOLEAN"}.get(type(field.dataType), "STRING")
        values[field.name] = typed(field.name, field.dataType.simpleString(), kind)
    problem = (
        F.when(~is_object, "not a JSON object").when(values["query_type"].isNull(), "missing query_type")
        .when(~values["query_type"].isin(tx.QUERY_TYPES), "unknown query_type").when(values["explanation"].isNull(), "missing explanation")
    )
    checked = parsed.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    stock = {"query_type": "unsupported", "explanation": tx.UNREADABLE_QUESTION}
    return checked.withColumns({n: F.when(ok, v).otherwise(F.lit(stock.get(n))) for n, v in values.items()}).drop("_v")


def query_prompts(turns: DataFrame, schema_text: Column, system_prompt: str = PARSE_PROMPT, k: int = 8) -> DataFrame:
    """(conv_id, messages): per conversation the task, up to `k` turns before its last one, and that one with the schema.

    Conversations whose last turn is not the user's ask nothing and have no row.
    """
    last = context_window(turns, k + 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("t"))
    message = lambda role, content: F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"))
    question = F.element_at("t", -1)
    history = F.transform(F.slice("t", 1, F.size("t") - 1), lambda t: message(t["role"], t["content"]))
    asked = F.concat(F.lit("Schema:\n"), schema_text, F.lit("\n\nQuestion: "), question["content"])
    return last.where(question["role"] == "user").select(
        "conv_id", F.concat(F.array(message("system", F.lit(system_prompt))), history, F.array(message("user", asked))).alias("messages"))


def summary_prompts(profiles: DataFrame, system_prompt: str = SUMMARY_PROMPT) -> DataFrame:
    """(window_label, messages) of every profile with rows: its counts, most frequent first, as the text to summarise."""
    def line(title: str, dimension: str) -> Column:
        own = F.transform(F.filter("counts", lambda x: x["dimension"] == dimension), lambda x: F.struct((-x["count"]).alias("minus"), x["value"].alias("value")))
        shown = F.transform(F.array_sort(own), lambda x: F.concat(x["value"], F.lit(": "), (-x["minus"]).cast("string")))
        return F.concat(F.lit(title + ": "), F.array_join(shown, ", "))

    lines = [line(key.replace("_", " "), dimension) for dimension, key in STAT_KEYS.items()]
    text = F.concat_ws("\n", *lines, F.concat(F.lit("total: "), F.col("total_reviews").cast("string")))
    return profiles.where("total_reviews > 0").select("window_label", _two(system_prompt, text))


def followup_prompts(summaries: DataFrame, system_prompt: str = FOLLOWUP_PROMPT) -> DataFrame:
    """(window_label, messages) of every summary: narrative and stats, to ask for follow-up questions."""
    text = F.concat(F.lit("Summary: "), F.col("narrative"), F.lit("\n\nStats: "), F.col("stats"))
    return summaries.where("narrative IS NOT NULL").select("window_label", _two(system_prompt, text))


def _two(system_prompt: str, text: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content"))
    ).alias("messages")
