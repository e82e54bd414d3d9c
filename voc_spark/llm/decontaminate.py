"""Documents that hold a passage of a benchmark item, found through the CGK embedding of edit distance.

Words are lower-cased and stripped of punctuation at their edges. An item of n words is found where some n words of a document
(fewer at its end) are at most n / 5 word edits away. Every window of an item's size is embedded by CGK random walks: each step
writes the current word and moves on if a random bit of (step, word) says so, so that few edits give few differing steps.
Each walk samples some steps as a signature; as many walks are made as the target recall asks for, measured on
items edited as far as allowed. Windows that share a signature with an item are verified by the exact edit distance.

Before that, a window must hold as many word triples of the items as an unedited remainder of that size has at
least (each edit spoils three), which loses nothing. Items are taken in passes of at most ITEMS_PER_PASS, so what a task holds is
bounded; documents are only mapped over, never shuffled.

Null texts are empty. Items of fewer than 5 words are left out, as are null items; of five words they match exactly. Repeated
rows and repeated items are each found on their own. Empty tables give an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from voc_spark.llm.common import carry, pick

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>|/\\*#$%&@=+~^`_-–—…«»„“”‚‘’¡¿"
LEAST_WORDS, EDIT_SHARE = 5, 0.2
#: Steps of a signature, share of edited windows to reach, most walks.
SAMPLED, RECALL, MOST_WALKS = 2, 0.98, 48
ITEMS_PER_PASS = 20_000
BLOCK_WORDS, KNOWN_WORDS, TRIPLE_BITS = 200_000, 1_000_000, 22
PAD = np.uint64(0)
MATCHES = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"

carry(__name__)


def word_code(word: str) -> int:
    """64 bits that name a word; 0 for a word of punctuation only, which is skipped."""
    w = word.lower().strip(EDGES)
    return (xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7) or 1) if w else 0


ASCII_EDGES = EDGES.encode("ascii", "ignore")


def byte_code(word: bytes) -> int:
    """`word_code` of a word in UTF-8."""
    if not word.isascii():
        return word_code(word.decode("utf-8", "surrogatepass"))
    w = word.lower().strip(ASCII_EDGES)
    return (xxh64_intdigest(w, 7) or 1) if w else 0


class ByteCodes(dict):
    """Codes of the words in UTF-8 met so far."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = byte_code(word)
        return code


class Codes(dict):
    """Codes of the words met so far."""

    def __missing__(self, word: str) -> int:
        code = self[word] = word_code(word)
        return code


def codes_of(text: str) -> np.ndarray:
    codes = np.array([word_code(w) for w in WORDS.findall(text or "")], np.uint64)
    return codes[codes != 0]


def allowed(n: int) -> int:
    """Edits allowed for an item of n words."""
    return 0 if n <= LEAST_WORDS else int(n * EDIT_SHARE)


def triples(codes: np.ndarray) -> np.ndarray:
    """A small hash of each three words in a row."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TRIPLE_BITS)).astype(np.int64)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edits between two word lists, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [far] * (len(b) + 1)
        lo, hi = max(1, i - most), min(len(b), i + most)
        now[lo - 1] = i if lo == 1 else far
        for j in range(lo, hi + 1):
            now[j] = min(before[j - 1] + (x != b[j - 1]), before[j] + 1, now[j - 1] + 1)
        before = now
        if min(before) > most:
            return far
    return min(before[len(b)], far)


class Walks:
    """CGK walks with their sampled steps, for the sizes of one set of items."""

    def __init__(self, sizes: list[int], walks: int, seed: int = 3):
        r = np.random.default_rng(seed)
        self.walks, self.longest = walks, 3 * max(sizes)
        self.odd = r.integers(1, 1 << 63, (self.longest, walks, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = r.integers(1, 1 << 63, (walks, 1), dtype=np.uint64)
        # The sampled steps are places in the walk relative to its length, so they are drawn once per size.
        self.taken = {n: np.zeros((self.longest, walks), bool) for n in sizes}
        for n in sizes:
            for k in range(walks):
                self.taken[n][r.choice(3 * n, SAMPLED, replace=False), k] = True

    def signatures(self, codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """(walks, windows) of the windows of n codes from each start; `codes` has n codes of padding at its end."""
        at = np.repeat(starts[None, :], self.walks, axis=0)
        end = starts[None, :] + n
        out = np.repeat(self.salt, len(starts), axis=1)
        for step in range(3 * n):
            seen = np.where(at < end, codes[np.minimum(at, len(codes) - 1)], PAD)
            taken = self.taken[n][step]
            if taken.any():
                out[taken] = (out[taken] ^ seen[taken]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)
                out[taken] ^= out[taken] >> np.uint64(29)
            at += ((seen * self.odd[step]) >> np.uint64(63)).astype(at.dtype)
        return out

    def outputs(self, codes: np.ndarray, n: int) -> np.ndarray:
        """(steps, walks): what each walk over one window writes."""
        at, rows = np.zeros((self.walks, 1), np.int64), []
        for step in range(3 * n):
            seen = np.where(at < min(n, len(codes)), codes[np.minimum(at, len(codes) - 1)], PAD)
            rows.append(seen[:, 0])
            at += ((seen * self.odd[step]) >> np.uint64(63)).astype(at.dtype)
        return np.array(rows)


def walks_for(items: list[np.ndarray], recall: float = RECALL, tries: int = 200, seed: int = 9) -> int:
    """Walks needed so that windows edited as far as allowed share a signature with probability `recall` on average."""
    r = np.random.default_rng(seed)
    some = [items[i] for i in r.permutation(len(items))[:tries]]
    probe = Walks(sorted({len(x) for x in some}), 8)
    agree = []
    for x in some:
        y = x.tolist()
        for _ in range(allowed(len(x))):
            kind, at = r.integers(3), int(r.integers(len(y)))
            if kind == 0:
                y[at] = int(r.integers(1, 1 << 62))
            elif kind == 1:
                y.insert(at, int(r.integers(1, 1 << 62)))
            else:
                del y[at]
        y = np.array(y[:len(x)], np.uint64)
        agree += (probe.outputs(x, len(x)) == probe.outputs(y, len(x))).mean(axis=0).tolist()
    hit = np.array(agree) ** SAMPLED
    for n in range(4, MOST_WALKS):
        if 1 - np.mean((1 - hit) ** n) >= recall:
            return n
    return MOST_WALKS


class Index:
    """One pass of items, with what finds them."""

    def __init__(self, items: list[tuple[int, str]], recall: float = RECALL):
        coded = [(i, codes_of(t)) for i, t in items]
        self.items = [(i, c) for i, c in coded if len(c) >= LEAST_WORDS]
        self.words = [set(c.tolist()) for _, c in self.items]
        self.repeats = [{w: k for w, k in Counter(c.tolist()).items() if k > 1} for _, c in self.items]
        self.sizes = sorted({len(c) for _, c in self.items})
        self.known = ByteCodes()
        if not self.items:
            return
        self.walks = Walks(self.sizes, walks_for([c for _, c in self.items], recall))
        # Which sizes of items have a triple, one bit per size (sizes may share a bit).
        self.bit = {n: np.uint64(k % 64) for k, n in enumerate(self.sizes)}
        self.triple = np.zeros(1 << TRIPLE_BITS, np.uint64)
        self.least = min(self.need(n) for n in self.sizes)
        self.found: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for k, (_, c) in enumerate(self.items):
            self.triple[triples(c)] |= np.uint64(1) << self.bit[len(c)]
            own = self.walks.signatures(np.concatenate([c, np.zeros(len(c), np.uint64)]), np.zeros(1, np.int64), len(c))
            for w, s in enumerate(own[:, 0].tolist()):
                self.found[len(c), w, s].append(k)

    @staticmethod
    def need(n: int) -> int:
        """Triples of an item of n words that are left after the edits allowed."""
        return n - 2 - 3 * allowed(n)

    def code(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text (item_id, start, end, edits) of each item in it, counted in words of the text: of the windows close enough, the one that shares most walks."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        raw = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at the blanks of WORDS
        all_codes = self.code([w for words in raw for w in words])
        # One line of codes, each text followed by padding of the longest item, so no window reaches into the next text.
        gap, at, line, owner, place = self.sizes[-1], 0, [], [], []
        for k, words in enumerate(raw):
            own = all_codes[at:at + len(words)]
            at += len(words)
            kept = np.flatnonzero(own)
            own = own[kept]
            if len(own) < LEAST_WORDS:
                continue
            hits = np.flatnonzero(self.triple[triples(own)])
            # Some triples of the items must stand within the longest item.
            if len(hits) < self.least or (self.least > 0 and (hits[self.least - 1:] - hits[:len(hits) - self.least + 1]).min() >= gap):
                continue
            line += [own, np.zeros(gap, np.uint64)]
            owner.append(np.full(len(kept) + gap, k))
            place += [kept, np.zeros(gap, np.int64)]
        if not line:
            return out
        codes, owner, place = np.concatenate(line), np.concatenate(owner), np.concatenate(place)
        sizes_at = self.triple[triples(codes)]
        words_in = np.concatenate([[0], np.cumsum(codes != 0), np.full(gap + 2, (codes != 0).sum())])
        here = np.flatnonzero(codes)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in self.sizes:
            total = np.concatenate([[0], np.cumsum((sizes_at >> self.bit[n]) & np.uint64(1)), np.zeros(gap + 2, np.uint64)]).astype(np.int64)
            total[len(sizes_at) + 1:] = total[len(sizes_at)]
            enough = (total[here + n - 2] - total[here] >= self.need(n)) & (words_in[here + n] - words_in[here] >= n - allowed(n))
            starts = here[enough]
            for a in range(0, len(starts), 4096):
                self._verify(codes, starts[a:a + 4096], n, owner, best)
        for (k, item), (edits, start, end) in best.items():
            out[k].append((self.items[item][0], int(place[start]), int(place[end - 1]) + 1, edits))
        return [sorted(o) for o in out]

    def _verify(self, codes: np.ndarray, starts: np.ndarray, n: int, owner: np.ndarray, best: dict) -> None:
        if not len(starts):
            return
        votes: Counter[tuple[int, int]] = Counter()
        windows: dict[int, tuple[list[int], set[int]]] = {}
        for w, row in enumerate(self.walks.signatures(codes, starts, n).tolist()):
            for start, s in zip(starts.tolist(), row):
                for item in self.found.get((n, w, s), ()):
                    votes[start, item] += 1
        for (start, item), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            key = (int(owner[start]), item)
            if key in best:
                continue
            if start not in windows:
                window = codes[start:start + n]
                window = window[window != 0].tolist()
                windows[start] = window, set(window)
            window, words = windows[start]
            both = words & self.words[item]
            shared = len(both) + sum(min(window.count(w), k) - 1 for w, k in self.repeats[item].items() if w in both)
            if len(window) - shared > allowed(n):  # words too many for the item are an edit each
                continue
            edits = edit_distance(window, self.items[item][1].tolist(), allowed(n))
            if edits <= allowed(n):
                best[key] = (edits, start, start + len(window))


def passes(items: DataFrame, per_pass: int = ITEMS_PER_PASS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in passes of about `per_pass`, the most that a task holds at once."""
    rows = pick(items, item_id="long", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = -(-rows.count() // per_pass)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def matches(text: Column, index: Index, once: bool = False) -> Column:
    """Array of (item_id, start, end, edits) found in each text."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list[list[dict]] = []
            some, size = [], 0
            texts = s.tolist()
            for i, t in enumerate(texts):
                some.append(t or "")
                size += len(some[-1]) // 5 + 1
                if size >= BLOCK_WORDS or i == len(texts) - 1:
                    out += [[dict(zip(("item_id", "start", "end", "edits"), m)) for m in found] for found in index.search(some)]
                    some, size = [], 0
            yield pd.Series(out, dtype=object)

    search = F.pandas_udf(run, MATCHES)
    return (search.asNondeterministic() if once else search)(text)


def leaks(docs: DataFrame, items: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start, end, edits: each item in each document that holds it."""
    docs, found = pick(docs, doc_id="long", text="string"), None
    for part in passes(items):
        # Called non-deterministic so that the filter which Catalyst derives from `inline` is not moved below it: that would search twice.
        here = docs.select("doc_id", matches(F.col("text"), Index(part, recall), True).alias("m")).select("doc_id", F.inline("m"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return docs.select("doc_id", F.explode(F.array().cast(MATCHES)).alias("m")).select("doc_id", "m.*")
    return found


def without_leaks(docs: DataFrame, items: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for part in passes(items):
        docs = docs.where(F.size(matches(F.col("text").cast("string"), Index(part, recall))) == 0)
    return docs
