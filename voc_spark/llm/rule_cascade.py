"""Quality rules as a short-circuit cascade, DataFrame functions only.

Each rule is tried on a sample of documents: the share it rejects and the time it takes. Rules are then
ordered by rejection per cost, and the verdict is one nested CASE, so a document that fails an early
rule is never looked at by a later one. The order changes the work, never the verdict.

Null, empty and blank texts have no words and fail the base rule. Repeated rows are judged alike, each
on its own; other columns of the input are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc_spark.llm.common import BLANKS, WORD, let, pick
from voc_spark.sources.parquet import stored

SYMBOLS = "#*$%&|<>"
#: Documents that the costs and rejections are estimated on.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """`fails` is true for a document to reject; it may use `text` and the base statistics."""

    name: str
    fails: Column


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return (
        docs.withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", let(words, _repeated).cast("long"))
    )


def _repeated(words: Column) -> Column:
    """Words inside any 3-word window that the text has at least twice, each word counted once.

    Windows are compared by a 64-bit hash; sorting (hash, position) brings equal ones together, so
    the work is n log n for a text of any length.
    """
    n = F.size(words)
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"])), lambda p: p.isNotNull()))
    covered = lambda q: F.aggregate(
        F.transform(q, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return let(F.sort_array(windows), lambda s: let(starts(s), covered))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Limits on symbols, word length, repeated lines, capitals, exclamation marks and cell bars."""
    share = lambda pattern: F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 14 * F.col("n_words")),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))),
        Rule("capitals", 2 * share("[A-Z]") > F.col("word_chars")),
        Rule("exclamations", 5 * share("!") > F.col("n_words")),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Estimate]:
    """Rejected share and seconds of each rule alone on one stored sample of about `sample_rows` documents.

    The base statistics are computed for every document anyway, so a rule's cost is what it adds to them.
    """
    total = docs.count()
    if not total:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    sample = stored(with_base(docs.sample(min(1.0, sample_rows / total), seed)), "cascade-sample")
    rows, found = max(1, sample.count()), []
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(F.coalesce(rule.fails, F.lit(False)))).first()[0]
        found.append(Estimate(rule, rejected / rows, time.perf_counter() - began))
    return found


def order(estimates: Sequence[Estimate]) -> list[Rule]:
    """Highest rejection per second first; ties by name."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.gain, e.rule.name))]


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects the document, null if none does; later rules are not evaluated."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    return verdict


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base statistics, base_failed, failed_rule and kept of each document."""
    rules = default_rules() if rules is None else list(rules)
    docs = pick(docs, doc_id="long", text="string")
    ordered = order(estimate(docs, rules, sample_rows))
    return (
        with_base(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rule", cascade(ordered))
        .withColumn("kept", F.col("failed_rule").isNull())
        .drop("text")
    )
