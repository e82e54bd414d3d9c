"""Toxic spans by a linear-chain conditional random field over words.

Tokens of labelled documents are labelled first: a word feature that is frequent in toxic documents and next to absent from
clean ones marks the words that carry it. The field (hashed word, prefix and suffix features, two states, four
transitions) is fitted to those labels by its exact gradient. Scoring runs forward and backward over every word of
every text; the marginals give the offending spans and, through a small logistic unit, the document's score.

Scoring is a map over the table: no shuffle, memory bounded by a block of words. Null texts are empty ones; texts without
words get the score of no evidence and no spans. Repeated rows are scored alike, each on its own. With fewer than LEAST_DOCS documents of
either label nothing can be learnt: every score is the same low one and there are no spans. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc_spark.llm.common import carry, held_out, labelled_sample, pick

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_…"
PREFIXES, SUFFIX, BUCKETS = (4, 5, 6, 7), 4, 1 << 19
#: Labelled documents for fitting, and the longest of them in characters.
FIT_ROWS, FIT_CHARS = 3_000, 8_000
#: A feature marks toxic words if at least so many toxic documents have it and so few of those that have it are clean.
LEAST_DOCS, CLEAN_SHARE = 5, 0.15
#: Marginals below this don't count towards a document's score.
LEAST_P = 0.1
BLOCK_WORDS, KNOWN_WORDS = 200_000, 1_000_000
OUTPUT = "doc_id long, held_out boolean, score double, spans array<struct<start:int,end:int,p:double>>"

carry(__name__)


def word_features(word: str) -> list[str]:
    w = word.lower().strip(EDGES)
    n = len(w)
    return ["", "=" + w, *[w[:k] for k in PREFIXES if n > k], "-" + w[-SUFFIX:]]


def buckets(word: str) -> list[int]:
    return [crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in word_features(word)]


@dataclass
class Crf:
    weights: np.ndarray  # of state 1 by feature bucket; state 0 has none
    trans: np.ndarray  # [before, after], log
    start: np.ndarray  # log
    head: np.ndarray  # of the document's features, bias last


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token and the summed pair marginals; `first` marks where a sequence begins.

    Tokens are laid out in rows of about the root of their number. Each row's effect is first found for both
    states that it may be entered in, all rows at once; then the rows are chained, then the inner values are filled in.
    """
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    T, s = np.exp(trans), np.exp(start)
    x = np.exp(np.clip(e, -30, 30))

    def grid(a: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(rows * length, fill, a.dtype)
        out[:n] = a
        return np.ascontiguousarray(out.reshape(rows, length).T)

    ahead = _chain(grid(x, 1.0), grid(first, True), T, s, rows, length)[:n]
    # Backwards, the vector carries the token's own weight too; a sequence's last token is where it starts anew.
    last = np.append(first[1:], True)
    back = _chain(grid(x[::-1].copy(), 1.0), grid(last[::-1].copy(), True), T.T, np.ones(2), rows, length)[:n][::-1]
    one = ahead * back / x  # the token's own weight is in both
    p = one / (1 + one)
    both = ~first
    both[0] = False
    i = np.flatnonzero(both)
    pairs = np.zeros((2, 2))
    if len(i):
        a, b = ahead[i - 1], back[i]
        w = np.stack([np.full(len(i), T[0, 0]), T[0, 1] * b, T[1, 0] * a, T[1, 1] * a * b])
        pairs = (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return p, pairs


def _chain(x: np.ndarray, first: np.ndarray, T: np.ndarray, s: np.ndarray, rows: int, length: int) -> np.ndarray:
    """Odds of state 1 to 0 of the running product v' = (v T) * (1, x), begun anew with s * (1, x) at each first."""
    m = np.zeros((2, 2, rows))  # [entered in, now in]
    m[0, 0] = m[1, 1] = 1
    for t in range(length):
        new = np.empty_like(m)
        f = first[t]
        for k in (0, 1):
            v0, v1 = m[k]
            new[k, 0] = np.where(f, s[0] * (v0 + v1), v0 * T[0, 0] + v1 * T[1, 0])
            new[k, 1] = np.where(f, s[1] * (v0 + v1), v0 * T[0, 1] + v1 * T[1, 1]) * x[t]
        m = new / new.sum(axis=(0, 1))
    enter = np.empty((2, rows))
    v0, v1 = 0.5, 0.5
    for r in range(rows):
        enter[0, r], enter[1, r] = v0, v1
        a, b = v0 * m[0, 0, r] + v1 * m[1, 0, r], v0 * m[0, 1, r] + v1 * m[1, 1, r]
        v0, v1 = a / (a + b), b / (a + b)
    out = np.empty((length, rows))
    odds = enter[1] / np.maximum(enter[0], 1e-300)
    for t in range(length):
        odds = x[t] * np.where(first[t], s[1] / s[0], (T[0, 1] + odds * T[1, 1]) / (T[0, 0] + odds * T[1, 0]))
        out[t] = odds
    return out.T.ravel()


def weak_labels(docs: list[np.ndarray], labels: list[int], least: int = LEAST_DOCS, clean_share: float = CLEAN_SHARE) -> np.ndarray:
    """Which buckets mark toxic words, from each document's buckets. The bias, which every word has, marks none."""
    seen = np.zeros((2, BUCKETS), np.int32)
    for own, y in zip(docs, labels):
        seen[y, np.unique(own)] += 1
    return (seen[1] >= least) & (seen[0] <= clean_share * seen[1])


def doc_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Highest marginal, expected toxic words among those of at least LEAST_P (log), their density, the words (log), and 1.

    Small marginals don't add up, so a long clean text stays clean.
    """
    out = np.zeros((len(counts), 5))
    out[:, 3] = np.log1p(counts) / 10
    out[:, 4] = 1
    full = counts > 0
    first = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
    if len(first):
        total = np.add.reduceat(np.where(p >= LEAST_P, p, 0), first)
        out[full, 0] = np.maximum.reduceat(p, first)
        out[full, 1] = np.log1p(total)
        out[full, 2] = total / counts[full]
    return out


def fit(rows: list[tuple[str, int]], steps: int = 60, rate: float = 0.3, penalty: float = 0.05) -> Crf:
    """The same rows give the same field. Too few rows of either label give the field without evidence."""
    empty = Crf(np.full(BUCKETS, -1.0), np.log(np.array([[0.99, 0.01], [0.5, 0.5]])), np.log(np.array([0.99, 0.01])), np.array([0.0, 0.0, 0.0, 0.0, -4.0]))
    if min(sum(y == k for _, y in rows) for k in (0, 1)) < LEAST_DOCS:
        return empty
    texts, labels = [WORDS.findall(t or "") for t, _ in rows], [y for _, y in rows]
    ids: dict[str, int] = {}
    tokens = np.array([ids.setdefault(w, len(ids)) for words in texts for w in words], np.int64)
    counts = np.array([len(w) for w in texts])
    del texts
    owner = np.repeat(np.array(labels), counts)
    sizes = np.fromiter((len(buckets(w)) for w in ids), np.int64, len(ids))
    flat, of = np.fromiter((b for w in ids for b in buckets(w)), np.int32, int(sizes.sum())), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    begin = np.cumsum(sizes) - sizes
    per_doc = [np.concatenate([flat[begin[t]:begin[t] + sizes[t]] for t in np.unique(part)] or [flat[:0]]) for part in np.split(tokens, np.cumsum(counts)[:-1])]
    marks = weak_labels(per_doc, labels)
    del per_doc
    marked = np.bincount(of, marks[flat], len(ids)) > 0
    y = (marked[tokens] if len(tokens) else np.zeros(0, bool)) & (owner == 1)
    first = np.zeros(len(tokens), bool)
    begins = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
    first[begins] = True
    used, flat = np.unique(flat, return_inverse=True)
    w, trans, start = np.zeros(len(used)), empty.trans.copy(), empty.start.copy()
    w[np.searchsorted(used, crc32(b"") % BUCKETS)] = -3.0  # words are clean until shown otherwise
    inner = ~first
    inner[:1] = False
    i = np.flatnonzero(inner)
    true_pairs = np.bincount(2 * y[i - 1] + y[i], minlength=4).reshape(2, 2) if len(i) else np.zeros((2, 2))
    true_start = np.bincount(y[begins].astype(int), minlength=2)
    per_word, gw, gt, gs = np.bincount(tokens, y, len(ids)), np.zeros_like(w), np.zeros((2, 2)), np.zeros(2)
    for _ in range(steps):  # gradient ascent with per-weight scaling
        score = np.bincount(of, w[flat], len(ids))
        p, pairs = marginals(score[tokens], first, trans, start)
        miss = per_word - np.bincount(tokens, p, len(ids))
        g = np.bincount(flat, miss[of], len(used)) - penalty * w
        gw += g * g
        w += rate * g / np.sqrt(gw + 1e-9)
        d = true_pairs - pairs - 0.1 * trans
        gt += d * d
        trans += 0.2 * rate * d / np.sqrt(gt + 1e-9)
        begun = p[begins].sum()
        d = true_start - np.array([len(begins) - begun, begun]) - 0.1 * start
        gs += d * d
        start += 0.2 * rate * d / np.sqrt(gs + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    p, _ = marginals(np.bincount(of, w[flat], len(ids))[tokens], first, trans, start)
    return Crf(weights, trans, start, _logistic(doc_features(p, counts), np.array(labels, float)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Newton's method; a penalty keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) / len(y) - penalty * w)
    return w


class Scores(dict):
    """Scores of the words met so far."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        score = self[word] = sum([self.weights[b] for b in buckets(word)])
        return score


class Tagger:
    """A field with the scores of the words it has met; the memory of words is emptied when it is full."""

    def __init__(self, field: Crf):
        self.field, self.known = field, Scores(field.weights)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def tag(self, texts: list[str], least: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score per text, and per text the spans (start, end, p) of its words that are toxic with p of at least `least`."""
        found = [WORDS.findall(t) for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        words = [w for f in found for w in f]
        first = np.zeros(len(words), bool)
        ends = np.cumsum(counts)
        first[(ends - counts)[counts > 0]] = True
        p, _ = marginals(self.scores(words), first, self.field.trans, self.field.start)
        z = doc_features(p, counts) @ self.field.head
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hits = np.flatnonzero(p >= least)
        for d in np.unique(np.searchsorted(ends, hits, side="right")):
            own = p[ends[d] - counts[d]:ends[d]]
            spans[d] = [(m.start(), m.end(), float(q)) for m, q in zip(WORDS.finditer(texts[d]), own) if q >= least]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> Crf:
    return fit(labelled_sample(docs, labels, "toxic", rows, max_chars))


def score(docs: DataFrame, field: Crf) -> DataFrame:
    """doc_id, held_out, score and spans (code points, end exclusive) of each row of (doc_id, text)."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for b in batches:
            scores, spans, some, size = [], [], [], 0
            for t in b.column("text").to_pylist():
                some.append(t)
                size += len(t) // 5 + 1
                if size >= BLOCK_WORDS:
                    s, found = tagger.tag(some)
                    scores.append(s)
                    spans += found
                    some, size = [], 0
            s, found = tagger.tag(some)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            marked = pa.array([[dict(zip(("start", "end", "p"), x)) for x in f] for f in spans + found], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate([*scores, s])), marked], ["doc_id", "held_out", "score", "spans"])

    return rows.mapInArrow(run, OUTPUT)


def without_toxic(docs: DataFrame, field: Crf, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below `threshold`, with all their columns."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(field)
        for s in series:
            scores, some, size = [], [], 0
            for t in s:
                some.append(t or "")
                size += len(some[-1]) // 5 + 1
                if size >= BLOCK_WORDS:
                    scores.append(tagger.tag(some, 2.0)[0])
                    some, size = [], 0
            yield pd.Series(np.concatenate([*scores, tagger.tag(some, 2.0)[0]]))

    return docs.where(F.pandas_udf(run, "double")(F.col("text").cast("string")) < threshold)
