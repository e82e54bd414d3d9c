"""Spelling variants by permuterm rotations: words one edit apart, each pointed at a much more frequent neighbour.

Every word w of length L is written with a terminator '$' and enters the shuffle under keys that are rotations:
  full rotations  w[i:] $ w[:i] for i = 0..L, and
  skip rotations  w[i+1:] $ w[:i] for i = 0..L-1, the rotation that leaves out character i.
Two words of one length whose skip rotations at i are equal differ only at i (a replacement); a skip rotation of w equal to
a full rotation of v means v is w with character i deleted (an insertion seen from v). The '$' fixes i in both. So a group
of equal keys is a prefix range of the sorted rotations that skips the edited character, and one scan of a group yields
each word's neighbours. A deletion inside a run of equal characters gives the same word for every place of the run: only
the first place of a run counts it, so each neighbour is counted once. No pairs are emitted: each member of a group gets
its number of partners and its best partner from the group's array.

A group holds at most one full rotation and one skip rotation per letter that can stand at the skipped place, so at most
1 + the size of the alphabet (26 lower-case ASCII letters and the 64 code points U+00C0-U+00FF): 91 members, whatever
the data. Word counts are combined before any shuffle, so frequent words cost one row each.

Forms: a word's form is its neighbour of largest n (ties: the smaller word in code-point order) if that n is at least
`ratio` times its own; n grows by that factor along forms, so chains are short, and roots are found by pointer jumping,
each round a stored table.

Edge cases: null texts have no runs; a null doc_id hashes as the empty text. Repeated rows count each time. Words have at
least `least_chars` code points and occur `least_n` times; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc_spark.llm.common import ascii_lower, pick
from voc_spark.sources.parquet import stored

# Fixed values of the contract: letters of a run, the divisor that picks runs to edit, the sizes of words, the form ratio.
RUN = r"[A-Za-zÀ-ÿ]+"
EDIT_EVERY, LEAST_CHARS, LEAST_N, RATIO = 31, 7, 2, 10
END = "$"
#: Rounds of pointer jumping before giving up; n grows tenfold per form, so 2^6 steps are far beyond any corpus.
MOST_ROUNDS = 6


def edited_runs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word) per run: lower-cased A-Z, one code point deleted where crc32('<doc_id>:<run>') is a multiple of 31."""
    rows = pick(docs, doc_id="long", text="string")
    runs = F.filter(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), 0), lambda r: F.length(r) >= least_chars)
    exploded = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = ascii_lower(F.col("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), low).cast("binary"))
    cut = exploded.select(low.alias("low"), h.alias("h")).withColumn("at", (F.col("h") % F.length("low")).cast("int"))
    deleted = F.concat(F.expr("substring(low, 1, at)"), F.expr("substring(low, at + 2)"))
    return cut.select(F.when(F.col("h") % EDIT_EVERY == 0, deleted).otherwise(F.col("low")).alias("word"))


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of words with at least `least_chars` code points and `least_n` occurrences."""
    return edited_runs(docs, least_chars).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, kind) with kind 0: skip rotation, 1: skip rotation at the first place of a run, 2: full rotation."""
    keys = F.concat(F.expr(f"transform(sequence(0, length(word) - 1), i -> named_struct('key', concat(substring(word, i + 2), '{END}', substring(word, 1, i)),"
                           " 'kind', IF(i = 0 OR substring(word, i + 1, 1) <> substring(word, i, 1), 1, 0)))"),
                    F.expr(f"transform(sequence(0, length(word)), i -> named_struct('key', concat(substring(word, i + 1), '{END}', substring(word, 1, i)), 'kind', 2))"))
    return words.select("word", "n", F.explode(keys).alias("r")).select("r.key", "word", "n", "r.kind")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) with best = struct(neg_n, word) of the neighbour of largest n, smallest word on ties."""
    groups = rotations(words).groupBy("key").agg(F.collect_list(F.struct("kind", (-F.col("n")).alias("neg_n"), "word")).alias("m")).where(F.size("m") >= 2)
    # For each member: its partners in the group. Skip members pair with other skip members (replacement) and, at the first
    # place of a run, with the full member (deletion); the full member pairs with skip members at the first place of a run.
    per = F.expr("""transform(m, x -> named_struct('word', x.word,
        'partners', filter(m, y -> y.word <> x.word AND ((x.kind < 2 AND y.kind < 2) OR (x.kind = 1 AND y.kind = 2) OR (x.kind = 2 AND y.kind = 1)))))""")
    each = groups.select(F.explode(per).alias("p")).where(F.size("p.partners") > 0)
    best = F.array_min(F.transform("p.partners", lambda y: F.struct(y["neg_n"].alias("neg_n"), y["word"].alias("word"))))
    return each.groupBy(F.col("p.word").alias("word")).agg(F.sum(F.size("p.partners")).cast("long").alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(word, root) for words with a form: pointer jumping over (word, form), each round stored."""
    now = stored(forms.select("word", F.col("form").alias("to")), "spelling-roots")
    for _ in range(most_rounds):
        nxt = now.alias("a").join(now.alias("b"), F.col("a.to") == F.col("b.word"), "left").select(
            F.col("a.word"), F.coalesce(F.col("b.to"), F.col("a.to")).alias("to"), F.col("b.to").isNotNull().alias("moved"))
        nxt = stored(nxt, "spelling-roots")
        if not nxt.where("moved").limit(1).count():
            return nxt.select("word", F.col("to").alias("root"))
        now = nxt.drop("moved")
    raise RuntimeError("spelling forms did not settle")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    words = stored(word_counts(docs), "spelling-words")
    near = stored(neighbours(words), "spelling-near")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.neg_n")).alias("best_n"), F.col("best.word").alias("best_word"))
    has_form = F.col("best_n") >= ratio * F.col("n")
    formed = stored(joined.select("word", "n", "n_near", F.when(has_form, F.col("best_word")).alias("form"),
                                  F.when(has_form, F.col("best_n")).cast("long").alias("form_n")), "spelling-forms")
    root = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
