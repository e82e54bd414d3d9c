"""Exact substring dedup over UTF-8 bytes with suffix arrays built by Lyndon grouping.

A byte is removed if a `length`-byte string covering it also starts in a document with a smaller doc_id; strings never
cross documents and are judged on the input.

Spark finds where such strings can be. Every `length`-byte string holds `length - gram + 1` whole grams of `gram` bytes;
the leftmost gram of least hash among them, its anchor, depends on the string alone. The anchor with half of the other bytes before
it, or with the rest behind it where fewer stand before, is the string's core and depends on the string alone, too. Strings that start side by side and have one core
in one place are a unit. Only units travel, as hashes of their core and of their bytes (their context). Cores that only one doc_id has
are dropped; equal contexts are merged with the least and greatest doc_id that hold them, combined before the shuffle, so a
group of copies of any size is one context.

A core with one distinct context (copies of one passage) needs no array: all its strings go to its least holder, in Spark functions.
The bytes of other contexts are read once each. What such a context has beyond its farthest agreement with any other of its core is no one
else's. The rests are merged where equal, and different ones are one string with a unique separator after each, in which the core is one symbol. Its suffix array is built in two
steps without recursion: suffixes are grouped by their Lyndon prefix (up to the next smaller suffix, found with a stack
of previous- and next-smaller pointers; a context bounds it), the groups are ordered by that prefix, and one left-to-right
pass over the array puts each suffix's chain of previous-smaller suffixes at the front of their groups, which fixes the order
inside every group. Adjacent suffixes that agree in `length` bytes within their context form the runs of one string; the
least doc_id of a run decides which holders lose those bytes. Cores with up to `most_contexts` contexts are
collected one array each and passed many to an Arrow batch; a core with more goes an exact way instead: its strings
are grouped by their bytes in Spark, with the same result.

Edge cases: a null text is empty; texts shorter than `length` keep all bytes. A null doc_id is larger than every doc_id
and never smaller than another null one, so such rows lose bytes to any document and take none. Rows with equal doc_id
do not remove each other's bytes. An empty table gives an empty result; other columns are ignored. Rows are keyed by
their doc_id, where it has several texts also by a 64-bit text hash, and contexts by a 64-bit hash within their core's: two different texts or contexts that share
both would be taken as one (odds about n^2 / 2^64).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc_spark.llm.common import PACKED, carry, lean, pick, release
from voc_spark.sources.parquet import stored

# Fixed value of the contract: the length of a removed string in bytes.
LENGTH = 50
#: Bytes of an anchor gram, and the distinct contexts of one core that go through one suffix array.
GRAM, MOST_CONTEXTS = 16, 4096
#: Grams of a document whose least ones are found at once (positions must fit in 16 bits).
PIECE = 1 << 15
NO_ID = (1 << 63) - 1
#: The places of shared cores are found in so many passes, each over one part of the cores: a pass shuffles that part only.
PARTS = 2
_TOP = np.uint64(0xFFFFFFFFFFFF0000)

carry(__name__)

_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
UNIT = "k long, ch long, cid long, th long, start int, n int, off int, wide int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MIX^(i+1) and MIX^-i modulo 2^64 (MIX is odd, so it has an inverse)."""
    inverse = np.uint64(pow(int(_MIX), -1, 1 << 64))
    return (np.cumprod(np.full(n, _MIX, np.uint64), dtype=np.uint64),
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]), dtype=np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def least_grams(hashes: np.ndarray, count: int, span: int) -> np.ndarray:
    """For each of `count` starts the leftmost least of the `span` gram hashes from there: the anchor of the string that starts there.

    Grams are ordered by the top 48 bits of their hash, then by place; sliding minima by blocks (van Herk), no loop per byte.
    """
    found = np.empty(count, np.int64)
    for a in range(0, count, PIECE):
        b = min(count, a + PIECE)
        x = (hashes[a:b + span - 1] & _TOP) | np.arange(b + span - 1 - a, dtype=np.uint64)
        blocks = np.concatenate([x, np.full((-len(x)) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        found[a:b] = (np.minimum(behind[:b - a], ahead[span - 1:span - 1 + b - a]) & np.uint64(0xFFFF)).astype(np.int64) + a
    return found


def units(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, powers: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The units of some texts: maximal runs of strings with one anchor and the same longer side of it.

    `doc` is the text's index, `start` the first string's start and `n` their number. All of them hold the unit's core, `wide` bytes that begin `off` bytes
    after `start`: the anchor with the half of the other bytes before it, or the rest behind it. `k` is the core's hash, `ch` that of the unit's bytes.
    """
    data, half = b"".join(texts), (length - gram) // 2
    names = ("doc", "start", "n", "off", "wide", "k", "ch")
    if len(data) < length:
        return {name: np.zeros(0, np.int64) for name in names}
    arr = np.frombuffer(data, np.uint8).astype(np.uint64)
    power, inverse = powers if powers is not None and len(powers[0]) >= len(arr) else _powers(len(arr))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((arr + np.uint64(1)) * power[:len(arr)], dtype=np.uint64)])
    hashes = _mixed((sums[gram:] - sums[:-gram]) * inverse[:len(arr) - gram + 1])
    count = len(arr) - length + 1
    at = least_grams(hashes, count, length - gram + 1)
    before = at - np.arange(count) >= half
    code = at * 2 + before
    # Strings do not go over the end of their text.
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    outside = (ends[:, None] - np.arange(1, length)[None, :])[np.arange(1, length)[None, :] <= sizes[:, None]]
    code[outside[outside < count]] = -1
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    n = np.diff(np.append(first, count))
    inside = code[first] >= 0
    first, n = first[inside], n[inside]
    at, before = at[first], before[first]
    lo, hi = np.where(before, at - half, at), np.where(before, at + gram, at + length - half + 1)
    part = lambda a, b: (sums[b] - sums[a]) * inverse[a]
    k = _mixed(part(lo, hi) + before)
    ch = _mixed(part(first, first + n - 1 + length) * _MIX + (n * 64 + lo - first).astype(np.uint64))
    doc = np.searchsorted(ends, first, side="right")
    return dict(zip(names, (doc, first - (ends - sizes)[doc], n, lo - first, hi - lo, k.view(np.int64), ch.view(np.int64))))


def _chunks(f: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """The rows of a batch in parts of about CHUNK bytes, with their texts."""
    held, size, a = [], 0, 0
    for b, text in enumerate(f["text"], 1):
        held.append((text or "").encode("utf-8"))
        size += len(held[-1])
        if size >= CHUNK or b == len(f):
            yield f.iloc[a:b], held
            held, size, a = [], 0, b


def unit_rows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, narrow: bool = False, part: int = 0, parts: int = 1) -> DataFrame:
    """The units of every row of (cid, th, text), of which `k` modulo `parts` is `part`; `narrow` leaves (k, cid)."""
    columns = ("k", "cid") if narrow else ("k", "ch", "cid", "th", "start", "n", "off", "wide")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _powers(2 * CHUNK)
        for f in frames:
            for rows_here, texts in _chunks(f):
                u = units(texts, length, gram, powers)
                if parts > 1:
                    chosen = np.flatnonzero(u["k"] % parts == part)
                    u = {name: v[chosen] for name, v in u.items()}
                doc = u.pop("doc")
                u |= {name: rows_here[name].to_numpy()[doc] for name in ("cid", "th")}
                yield pd.DataFrame({name: u[name].astype(np.int64 if name in ("k", "ch", "cid", "th") else np.int32, copy=False) for name in columns})

    return rows.select("cid", "th", "text").mapInPandas(run, "k long, cid long" if narrow else UNIT)


def contexts_of(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes `ctx` of the contexts that each row of (text, asked) is asked for."""
    kept = ("k", "ch", "off", "wide", "low", "high", "n_ctx")
    out = "k long, ch long, off int, wide int, low long, high long, n_ctx long, ctx binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: list[tuple] = []
            for text, asked in zip(f["text"], f["asked"]):
                data = (text or "").encode("utf-8")
                found += [(*(x[name] for name in kept), data[x["start"]:x["start"] + x["n"] - 1 + length]) for x in asked]
            frame = pd.DataFrame(found, columns=[*kept, "ctx"])
            yield frame.astype({name: "int32" if name in ("off", "wide") else "int64" for name in kept})

    return texts.mapInPandas(run, out)


def suffix_array(t: list[int] | str, ends: list[int]) -> list[int]:
    """Suffix array of t, whose last symbol is the unique least; `ends[i]` is the first separator at or after i.

    Every separator is unique and smaller than every other symbol, so two suffixes compare within their own context.
    Symbols are held as the characters of one string: slices of it are compared and hashed whole.
    """
    n, text = len(t), t if isinstance(t, str) else "".join(map(chr, t))
    keys = [text[i:e + 1] for i, e in enumerate(ends)]
    nss, pss = [n] * n, [-1] * n
    stack: list[int] = []
    for i, k in enumerate(keys):
        while stack and keys[stack[-1]] > k:
            nss[stack.pop()] = i
        if stack:
            pss[i] = stack[-1]
        stack.append(i)
    # Groups: suffixes of equal Lyndon prefix t[i:nss[i]], ordered by that prefix.
    prefixes = [text[i:e] for i, e in enumerate(nss)]
    rank = {p: r for r, p in enumerate(sorted(set(prefixes)))}
    group = [rank[p] for p in prefixes]
    front = [0] * (len(rank) + 1)
    for g in group:
        front[g + 1] += 1
    for g in range(len(rank)):
        front[g + 1] += front[g]
    sa = [0] * n
    last = n - 1
    sa[front[group[last]]] = last
    front[group[last]] += 1
    # Suffixes whose next smaller suffix is s follow s: the chain s-1, pss(s-1), ... down to pss(s).
    for i in range(n):
        s = sa[i]
        p, stop = s - 1, pss[s]
        while p >= 0 and p != stop:
            g = group[p]
            sa[front[g]] = p
            front[g] += 1
            p = pss[p]
    return sa


def alike(ctxs: list[bytes], offs: list[int], length: int = LENGTH, gram: int = GRAM) -> list[list[int]]:
    """The contexts of one anchor in parts; no string anchored here is in contexts of two parts.

    A string has its anchor at the same place wherever it stands and holds half of its other bytes before or behind it:
    contexts that agree neither in that much before nor behind their anchor share no string.
    """
    half = (length - gram) // 2
    root = list(range(len(ctxs)))
    seen: dict[tuple[bool, bytes], int] = {}
    for j, (c, off) in enumerate(zip(ctxs, offs)):
        for key in ((True, c[off - half:off + gram]) if off >= half else None, (False, c[off:off + gram + half]) if off + gram + half <= len(c) else None):
            if key is None:
                continue
            a, b = seen.setdefault(key, j), j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    parts: dict[int, list[int]] = {}
    for j in range(len(ctxs)):
        a = j
        while root[a] != a:
            a = root[a]
        root[j] = a
        parts.setdefault(a, []).append(j)
    return list(parts.values())


def folded(ctxs: list[bytes], offs: list[int], wides: list[int]) -> list[list[int]]:
    """Contexts with their core, which every string of them holds, as one symbol of its own; equal cores are one symbol."""
    cores: dict[bytes, int] = {}
    return [[*c[:o], cores.setdefault(c[o:o + w], 256 + len(cores)), *c[o + w:]] for c, o, w in zip(ctxs, offs, wides)]


def shared_strings(ctxs: list[bytes] | list[list[int]], lows: list[int], highs: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(context, offset, least doc_id) for each `length`-byte string of the contexts that some holder loses.

    A single context (an anchor seen only in copies of one passage) needs no suffix array: all its strings go to its least holder.
    """
    k = len(ctxs)
    if k == 1:
        if lows[0] < highs[0]:
            yield from ((0, off, lows[0]) for off in range(len(ctxs[0]) - length + 1))
        return
    symbol = [chr(b + k) for b in range(1 + max(max(c, default=0) for c in ctxs))]
    parts: list[str] = []
    ends: list[int] = []
    owner: list[int] = []
    begin: list[int] = []
    for j, c in enumerate(ctxs):
        begin.append(len(ends))
        parts += map(symbol.__getitem__, c)
        parts.append(chr(k - 1 - j))  # unique separators, decreasing, the last one 0
        ends.extend([begin[j] + len(c)] * (len(c) + 1))
        owner.extend([j] * (len(c) + 1))
    t = "".join(parts)
    sa = suffix_array(t, ends)
    i = 0
    while i < len(sa):
        s = sa[i]
        if s + length > ends[s]:
            i += 1
            continue
        head = t[s:s + length]
        j = i + 1
        while j < len(sa) and sa[j] + length <= ends[sa[j]] and t[sa[j]:sa[j] + length] == head:
            j += 1
        least = min(lows[owner[sa[x]]] for x in range(i, j))
        for x in range(i, j):
            c = owner[sa[x]]
            if least < highs[c]:
                yield c, sa[x] - begin[c], least
        i = j


def _most_agreed(parts: list[bytes]) -> list[int]:
    """How many first bytes each part has in common with any other one; sorted, the closest is a neighbour."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    agreed = [0] * len(parts)
    for a, b in zip(order, order[1:]):
        x, y = parts[a], parts[b]
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
        n -= (differ.bit_length() + 7) // 8
        agreed[a] = max(agreed[a], n)
        agreed[b] = n
    return agreed


def lost_ranges(ctxs: list[bytes], offs: list[int], lows: list[int], highs: list[int], wide: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(context, first offset, last offset, least doc_id) of strings that some holder loses, for the contexts of one core of `wide` bytes at `offs`.

    A string holds the core, so contexts share it only if they agree around the core as far as it reaches. What a context has beyond its farthest agreement
    with any other belongs to it alone; the rests are merged where equal, and different ones get one suffix array.
    """
    before = _most_agreed([c[o + wide - 1::-1] if o + wide else b"" for c, o in zip(ctxs, offs)])
    behind = _most_agreed([c[o:] for c, o in zip(ctxs, offs)])
    rests: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    for j, (c, o) in enumerate(zip(ctxs, offs)):
        last = len(c) - length
        a = max(0, o + wide - before[j])
        b = min(last, o + behind[j] - length)
        if a > b or before[j] < wide or behind[j] < wide:
            a, b = last + 1, last
        else:
            rests.setdefault((c[a:b + length], o - a), []).append((j, a))
        if lows[j] < highs[j]:
            if a > 0:
                yield j, 0, a - 1, lows[j]
            if b < last:
                yield j, b + 1, last, lows[j]
    held = list(rests.values())
    low, high = [min(lows[j] for j, _ in m) for m in held], [max(highs[j] for j, _ in m) for m in held]
    if len(rests) == 1:
        (text, _), = rests
        for j, a in held[0]:
            if low[0] < highs[j]:
                yield j, a, a + len(text) - length, low[0]
        return
    texts = folded([c for c, _ in rests], [o for _, o in rests], [wide] * len(rests))
    open_: dict[int, tuple[int, int, int]] = {}
    for c, o, g in sorted(shared_strings(texts, low, high, length - wide + 1)) if texts else ():
        for j, a in held[c]:
            if g >= highs[j]:
                continue
            if j in open_ and open_[j][1:] == (a + o - 1, g):
                open_[j] = (open_[j][0], a + o, g)
                continue
            if j in open_:
                yield j, *open_[j]
            open_[j] = (a + o, a + o, g)
    for j, found in open_.items():
        yield j, *found


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row of docs.

    Rows are keyed by doc_id and, where an id has several texts, a 64-bit hash of the text: equal rows share their anchors and results.
    """
    spark = docs.sparkSession
    with lean(spark):
        rows = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("cid"), F.xxhash64("text").alias("th"), "text")
        # Only where one id has several texts their hash is needed; elsewhere it is 0, which takes no room in the shuffles of the anchors.
        several = stored(rows.groupBy("cid").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("cid", F.lit(True).alias("several")), "lyndon-several")
        rows = rows.join(several, "cid", "left").select("doc_id", "cid", F.when(F.col("several"), F.col("th")).otherwise(0).cast("long").alias("th"), "text")
        # Units are cheap to find again, so they are computed again instead of stored: first to find the shared cores, then, a part of the cores at a
        # time, to keep those units.
        spread = unit_rows(rows, length, gram, narrow=True).groupBy("k").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi")
        shared = stored(spread.select("k"), "lyndon-shared", **PACKED)
        del spread
        release(spark)
        found = []
        for part in range(PARTS):
            places = unit_rows(rows, length, gram, part=part, parts=PARTS).join(shared.where(F.pmod("k", F.lit(PARTS)) == part), "k", "left_semi")
            found.append(stored(places, "lyndon-places", **PACKED))
            del places
            release(spark)
        release(spark, shared)
        places = reduce(DataFrame.unionByName, found)
        # Contexts are keyed by a 64-bit hash within their core: their bytes are read from one of their places, where bytes are needed.
        contexts = stored(places.groupBy("k", "ch").agg(
            F.min("cid").alias("low"), F.max("cid").alias("high"), *[F.first(name).alias(name) for name in ("cid", "th", "start", "n", "off", "wide")]), "lyndon-distinct", **PACKED)
        release(spark)
        sizes = contexts.groupBy("k").agg(F.count("*").alias("n_ctx"))
        sized = stored(contexts.join(sizes, "k"), "lyndon-sized", **PACKED)
        del sizes
        release(spark, contexts)
        # Hits are ranges of string starts (lo..hi within the context) that holders above g lose.
        # One distinct context (copies of one passage): every string of it goes to its least holder, no suffix array needed.
        by_one = sized.where((F.col("n_ctx") == 1) & (F.col("low") < F.col("high"))).select("k", "ch", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"), F.col("low").alias("g"))
        asked = sized.where("n_ctx > 1").groupBy("cid", "th").agg(F.collect_list(F.struct("k", "ch", "start", "n", "off", "wide", "low", "high", "n_ctx")).alias("asked"))
        texts = rows.join(asked, ["cid", "th"]).groupBy("cid", "th").agg(F.first("text").alias("text"), F.first("asked").alias("asked"))
        several_ctx = stored(contexts_of(texts.select("text", "asked"), length), "lyndon-contexts", **PACKED)
        del asked, texts
        release(spark)
        small, large = several_ctx.where(F.col("n_ctx") <= most_contexts), several_ctx.where(F.col("n_ctx") > most_contexts)
        # Cores with 2 to `most_contexts` contexts: one array per core, many cores per Arrow batch.
        grouped = small.groupBy("k").agg(F.collect_list(F.struct("ch", "ctx", "off", "wide", "low", "high")).alias("cs"))

        def per_core(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out: list[tuple[int, int, int, int, int]] = []
                for k, members in zip(f["k"], f["cs"]):
                    for wide in {x["wide"] for x in members}:
                        part = [x for x in members if x["wide"] == wide]
                        ranges = lost_ranges([bytes(x["ctx"]) for x in part], [x["off"] for x in part], [x["low"] for x in part], [x["high"] for x in part], wide, length)
                        out += [(k, part[j]["ch"], lo, hi, g) for j, lo, hi, g in ranges]
                yield pd.DataFrame(out, columns=["k", "ch", "lo", "hi", "g"]).astype({"k": "int64", "ch": "int64", "lo": "int32", "hi": "int32", "g": "int64"})

        by_suffixes = grouped.mapInPandas(per_core, "k long, ch long, lo int, hi int, g long")
        # Cores with very many contexts: each string of each context, grouped by its bytes.
        strings = large.select("k", "ch", "ctx", "low", "high", F.explode(F.sequence(F.lit(0), F.length("ctx") - length)).alias("off"))
        strings = strings.withColumn("s", F.expr(f"substring(ctx, off + 1, {length})"))
        least = strings.groupBy("k", "s").agg(F.min("low").alias("g"))
        by_bytes = strings.join(least, ["k", "s"]).where("g < high").select("k", "ch", F.col("off").cast("int").alias("lo"), F.col("off").cast("int").alias("hi"), "g")
        hits = stored(by_one.unionByName(by_suffixes).unionByName(by_bytes), "lyndon-hits", **PACKED)
        del by_one, small, large, grouped, by_suffixes, strings, least, by_bytes
        release(spark, sized, several_ctx)
        lost = places.select("k", "ch", "cid", "th", "start").join(hits, ["k", "ch"]).where("cid > g").select(
            "cid", "th", F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi")).alias("b")).alias("r"))
        per_lost = stored(lost.groupBy("cid", "th").agg(F.collect_set("r").alias("starts")), "lyndon-lost", **PACKED)
        del lost
        release(spark, hits, *found)
    return _summaries(rows.join(per_lost, ["cid", "th"], "left"), length)


def removed_mask(n: int, ranges: list | None, length: int = LENGTH) -> np.ndarray:
    """Bytes covered by a `length`-byte string starting anywhere in one of the (a, b) ranges of starts, both ends included."""
    mask = np.zeros(n + 1, np.int32)
    for r in ranges or []:
        mask[r["a"]] += 1
        mask[min(n, r["b"] + length)] -= 1
    return np.cumsum(mask[:n]) > 0


def _summaries(joined: DataFrame, length: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n_bytes, n_removed, n_spans, digests = [], [], [], []
            for text, starts in zip(f["text"], f["starts"]):
                data = (text or "").encode("utf-8")
                gone = removed_mask(len(data), None if starts is None else list(starts), length)
                arr = np.frombuffer(data, np.uint8)
                n_bytes.append(len(data))
                n_removed.append(int(gone.sum()))
                n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (1 if len(gone) and gone[0] else 0)))
                digests.append(hashlib.sha256(arr[~gone].tobytes()).hexdigest())
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digests})

    return joined.select("doc_id", "text", "starts").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
