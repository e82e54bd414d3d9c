"""Chat history and follow-up questions."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from voc_spark import taxonomy as tx


def newest_first_thread(turns: DataFrame) -> DataFrame:
    """Turns of every conversation, newest first."""
    return turns.orderBy("conv_id", F.desc("turn"))


def turn_text(columns: list[str]) -> Column:
    """User text as it is; an assistant turn shows its explanation, else its narrative, else nothing."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("explanation", "narrative") if c in columns]
    fallback = [F.col("text")] if not given else []
    return F.when(F.col("role") == "user", F.col("text")).otherwise(F.coalesce(*given, *fallback, F.lit("")))


def context_window(turns: DataFrame, k: int = 8) -> DataFrame:
    """The last `k` turns of every conversation, oldest first, as (conv_id, position, role, content).

    The literal bound lets each map task keep k turns per conversation before the shuffle.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= k)
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return last.select(
        "conv_id", position.alias("position"), "turn",
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"),
        turn_text(turns.columns).alias("content"),
    )


def followup_questions(completion: Column, k: int = 3) -> Column:
    """The first `k` questions of a completion; the stock questions when it is missing.

    Blank lines are dropped before dashes are stripped, so a dash-only line stays as an empty question.
    """
    lines = F.filter(F.split(completion, "\n"), lambda q: F.trim(q, F.lit(WHITESPACE)) != "")
    clean = F.transform(F.slice(lines, 1, k), lambda q: F.trim(F.trim(q, F.lit("- ")), F.lit(WHITESPACE)))
    return F.coalesce(clean, F.array(*map(F.lit, tx.FALLBACK_FOLLOWUPS)))


WHITESPACE = " \t\n\r\x0b\x0c"


def parse_followups(df: DataFrame, completion: str = "completion", k: int = 3) -> DataFrame:
    """One row per suggested question, with its position."""
    others = [c for c in df.columns if c != completion]
    return df.select(*others, F.posexplode(followup_questions(F.col(completion), k)).alias("position", "question"))
