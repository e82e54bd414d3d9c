"""Importance resampling towards a target distribution with a head-tail vocabulary of hashed features.

Words are runs of ASCII letters and digits and of any non-ASCII code point, after A-Z are lower-cased; features are runs
of `low` to `high` consecutive words joined by one space. Each feature falls into bucket crc32(UTF-8) mod `buckets`.
Bucket totals of the corpus (s of S) and of the target (t of T) are exact: features are counted by Spark with map-side
combining, and the CRC is taken once per distinct feature, not per occurrence. A bucket's gain is
floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) with B the number of buckets.

Scoring a document needs each feature's bucket again. The head, the `head` most frequent features of the corpus, is sent
to the tasks with its exact CRC states: a frequent feature takes its bucket from there, and a longer feature whose
leading words are in the head continues the CRC from that state over the rest only. Tail features take the CRC directly.
The head is bounded by its parameter and the gains by the number of buckets; both are the only things broadcast.

Sampling is Gumbel-top-k: score = weight + floor(-1000 ln(-ln((h+0.5)/2^32))), h the first 32 bits of
sha256('<seed>:<doc_id>'); of the N documents with at least `least_words` words, the `percent` % with the highest score
are drawn, ties to the smaller doc_id, then fewer features. Ranks come from one distributed sort.

Edge cases: a null text has no words; a document without features has weight 0 and is scored like any other; a null
doc_id hashes as the empty text and sorts last among ties. Repeated rows are scored and ranked each on their own (equal
rows take neighbouring ranks). An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voc_spark.llm.common import ascii_lower, carry, let, pick, text_of
from voc_spark.llm.ranking import global_rank

# Fixed values of the contract: the word pattern, the buckets, the seed of the draw and its share.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Frequent features whose CRC states go to every task; a bound on what is broadcast, not on the result.
HEAD = 1 << 15

carry(__name__)

_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def features(words: list[str], low: int = 1, high: int = 1) -> Iterator[tuple[int, int]]:
    """(start, length) of every run of `low` to `high` words."""
    for n in range(low, high + 1):
        for i in range(len(words) - n + 1):
            yield i, n


def _words_column(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), 0)


def _runs_of(words: Column, n: int) -> Column:
    """Every run of n consecutive words joined by a space; none if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def _features_column(words: Column, low: int, high: int) -> Column:
    """Features of the words, which are computed once (a bound variable), not once per feature."""
    def body(ws: Column) -> Column:
        parts = [ws if n == 1 else _runs_of(ws, n) for n in range(low, high + 1)]
        return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]

    return let(words, body)


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets))


def feature_counts(texts: DataFrame, low: int = 1, high: int = 1) -> DataFrame:
    """(feature, n) over all rows of (text): every occurrence counted, combined before the shuffle."""
    grams = texts.select(F.explode(_features_column(_words_column(text_of()), low, high)).alias("feature"))
    return grams.groupBy("feature").agg(F.count("*").alias("n"))


def bucket_totals(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): one CRC per distinct feature."""
    return counts.groupBy(_bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, from the bucket totals of corpus and target (at most `buckets` rows each)."""
    s = np.zeros(buckets, np.int64)
    t = np.zeros(buckets, np.int64)
    for into, totals in ((s, corpus), (t, target)):
        for r in totals.collect():
            into[r.bucket] = r.n
    big_s, big_t = float(s.sum()), float(t.sum())
    ratio = ((t + 1).astype(np.float64) * (big_s + buckets)) / ((s + 1).astype(np.float64) * (big_t + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def head_states(counts: DataFrame, head: int = HEAD) -> dict[str, int]:
    """Exact CRC of the `head` most frequent features (ties by feature), keyed by the feature."""
    top = counts.orderBy(F.desc("n"), "feature").limit(head).select("feature", F.crc32(F.col("feature").cast("binary")).alias("crc"))
    return {r.feature: r.crc for r in top.collect()}


def _crc(words: list[str], start: int, n: int, states: dict[str, int]) -> int:
    """CRC of words[start:start+n] joined by spaces: from the head, or continued from the head state of its longest leading part."""
    feature = " ".join(words[start:start + n])
    if (state := states.get(feature)) is not None:
        return state
    for k in range(n - 1, 0, -1):
        if (state := states.get(" ".join(words[start:start + k]))) is not None:
            return zlib.crc32((" " + " ".join(words[start + k:start + n])).encode("utf-8"), state)
    return zlib.crc32(feature.encode("utf-8"))


def weigh(docs: DataFrame, gain: np.ndarray, states: dict[str, int], low: int = 1, high: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain, 0 without features) of each row of (doc_id, text)."""
    rows = pick(docs, doc_id="long", text="string")
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast((gain, states))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, heads = shared.value
        for f in frames:
            n_words, n_features, weight = [], [], []
            for text in f["text"]:
                words = words_of(text)
                total = count = 0
                for start, n in features(words, low, high):
                    total += int(g[_crc(words, start, n, heads) % buckets])
                    count += 1
                n_words.append(len(words))
                n_features.append(count)
                weight.append(total // count if count else 0)
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": n_words, "n_features": n_features, "weight": weight})

    return rows.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256('<seed>:<doc_id>')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, head: int = HEAD,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs with doc_id, n_words, n_features, weight, score and rank (1, 2, ... for drawn rows, else null)."""
    texts = pick(docs, doc_id="long", text="string")
    counts = feature_counts(texts, low, high).persist()
    try:
        gain = gains(bucket_totals(counts, buckets), bucket_totals(feature_counts(pick(target, text="string"), low, high), buckets), buckets)
        states = head_states(counts, head)
    finally:
        counts.unpersist()
    weighed = weigh(texts, gain, states, low, high).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return global_rank(weighed, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")],
                       eligible=F.col("n_words") >= least_words, percent=percent)
