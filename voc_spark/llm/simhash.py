"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints that differ in at most 4 of 64 bits agree on at least one of five bands (or on c of c + 4), so each
distinct fingerprint goes into one cell per band combination. All cells are range-sorted by (cell, Gray rank) and cut into
blocks: a cell of any size is spread over tasks, and neighbours in a block share most bits. A block is a tree: the bits that
all fingerprints of a node share are its masked pattern. Two nodes whose patterns differ in more bits than allowed are pruned
with all below them; two nodes whose members can't differ by more are linked as a whole. Blocks of one cell are
compared the same way, block pattern first. Each comparison returns a spanning forest, not all pairs, and connected components join these.

Null texts and texts without words have fingerprint zero and link like any other. Texts of fewer than four words are one shingle.
Repeated rows are rows of one group. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from voc_spark.llm.common import carry, pick
from voc_spark.llm.graph import components
from voc_spark.sources.parquet import stored

SHINGLE, SEED, NEAR = 4, 42, 4
BLOCK, FANOUT, CELL_ROWS = 2048, 16, 256

carry(__name__)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxh64_intdigest(line, SEED)], np.uint64)
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = np.fromiter((xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])), np.uint64, len(words) - SHINGLE + 1)
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):  # a long text in pieces
        bits += np.unpackbits(hashes[a:a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (signed) of each row of (doc_id, text)."""
    rows = pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["doc_id", "text_hash"]].assign(fp=np.array([fingerprint(t) for t in f["text"]], np.uint64).view(np.int64))

    return rows.mapInPandas(run, "doc_id long, text_hash long, fp long")


def gray_rank(c: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def band_masks(n: int, near: int = NEAR, cell_rows: int = CELL_ROWS) -> list[int]:
    """Masks of the band combinations of which a near pair shares at least one; finer for more fingerprints, exact for any."""
    bands = near + 1
    while n / 2 ** (64 * (bands - near) // bands) > cell_rows and bands < near + 6:
        bands += 1
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, bands - near)]


class GrayTree:
    """Levels of nodes over fingerprints in Gray order, leaves (single fingerprints) first."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.levels = [(fps, np.full(len(fps), ~np.uint64(0)), np.arange(len(fps) + 1))]
        while len(self.levels[-1][0]) > FANOUT:
            pattern, mask, _ = self.levels[-1]
            at = np.arange(0, len(pattern), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, at), np.bitwise_and.reduceat(~pattern & mask, at)
            ends = np.append(at, len(pattern))
            below = self.levels[-1][2]
            self.levels.append((ones, ones | zeros, below[ends]))


def links(a: GrayTree, b: GrayTree | None = None, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into the two trees' fingerprints (or one tree's own) that connect all that are near; not all pairs of a dense node."""
    own, b = b is None, b or a
    ka, kb = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[ka][0])), np.arange(len(b.levels[kb][0])), indexing="ij"))
    out_a, out_b = [], []
    while True:
        if own:
            i, j = i[i <= j], j[i <= j]
        (pa, ma, fa), (pb, mb, fb) = a.levels[ka], b.levels[kb]
        shared = ma[i] & mb[j]
        apart = np.bitwise_count((pa[i] ^ pb[j]) & shared)
        keep = apart <= near
        i, j, apart, shared = i[keep], j[keep], apart[keep], shared[keep]
        if ka == 0 and kb == 0:
            keep = i != j if own else slice(None)
            out_a.append(i[keep])
            out_b.append(j[keep])
            return np.concatenate(out_a), np.concatenate(out_b)
        whole = apart + np.bitwise_count(~shared) <= near  # no two members can be further apart
        for x, y in zip(i[whole], j[whole]):
            left, right = np.arange(fa[x], fa[x + 1]), np.arange(fb[y], fb[y + 1])
            out_a += [np.full(len(right), left[0]), left]
            out_b += [right, np.full(len(left), right[0])]
        i, j = i[~whole], j[~whole]
        if ka >= kb:
            i, j = _children(i, j, len(a.levels[ka - 1][0]))
            ka -= 1
            if own:  # both sides go down together
                j, i = _children(j, i, len(b.levels[kb - 1][0]))
                kb -= 1
        else:
            j, i = _children(j, i, len(b.levels[kb - 1][0]))
            kb -= 1


def _children(of: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (of[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    inside = child < n
    return child[inside], np.repeat(other, FANOUT)[inside]


def forest(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the first of its group."""
    root = np.arange(len(fps))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(fps)))
    return fps[at], fps[root[at]]


def blocks(distinct: DataFrame, masks: list[int], block: int = BLOCK) -> DataFrame:
    """combo, value (the cell), block, mask, pattern, fps: runs of at most `block` fingerprints in Gray order."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    cells = F.array(*[F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)])
    spread = distinct.select("fp", F.explode(cells).alias("c")).select("c.combo", "c.value", gray_rank(F.col("fp")).alias("gray"), "fp")
    ordered = spread.repartitionByRange("combo", "value", "gray").sortWithinPartitions("combo", "value", "gray").drop("gray")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, rest = TaskContext.get().partitionId(), 0, None

        def closed(f: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            change = (f["combo"].diff().fillna(1) != 0) | (f["value"] != f["value"].shift())
            place = np.arange(len(f)) - np.maximum.accumulate(np.where(change, np.arange(len(f)), 0))
            starts = np.flatnonzero(change.to_numpy() | (place % block == 0))
            fps = f["fp"].to_numpy().view(np.uint64)
            ones, zeros = np.bitwise_and.reduceat(fps, starts), np.bitwise_and.reduceat(~fps, starts)
            ends = np.append(starts[1:], len(f))
            ids = (part << 32) + made + np.arange(len(starts))
            made += len(starts)
            return pd.DataFrame({
                "combo": f["combo"].to_numpy()[starts], "value": f["value"].to_numpy()[starts], "block": ids,
                "mask": (ones | zeros).view(np.int64), "pattern": ones.view(np.int64), "fps": [fps[a:b].tobytes() for a, b in zip(starts, ends)]})

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            # The last cell may go on in the next frame: its unfinished block waits.
            tail = (f["combo"] == f["combo"].iloc[-1]) & (f["value"] == f["value"].iloc[-1])
            n = int(tail.sum()) % block
            rest = f.iloc[len(f) - n:].reset_index(drop=True)
            if n < len(f):
                yield closed(f.iloc[:len(f) - n].reset_index(drop=True))
        if rest is not None and len(rest):
            yield closed(rest)

    return stored(ordered.mapInPandas(cut, "combo int, value long, block long, mask long, pattern long, fps binary"), "gray-blocks")


def near_links(distinct: DataFrame, masks: list[int], block: int = BLOCK) -> DataFrame:
    """(u, v) among the distinct fingerprints that connect all pairs at NEAR bits or fewer."""
    cells = blocks(distinct, masks, block)

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for raw in f["fps"]:
                fps = np.frombuffer(raw, np.uint64)
                if len(fps) > 1:
                    found.append(forest(fps, *links(GrayTree(fps))))
            yield _edges(found)

    def between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for left, right in zip(f["fps_a"], f["fps_b"]):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                i, j = links(GrayTree(a), GrayTree(b))
                found.append(forest(np.concatenate([a, b]), i, j + len(a)))
            yield _edges(found)

    head = cells.select("combo", "value", "block", "mask", "pattern")
    more = stored(head.groupBy("combo", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "gray-split")
    head = head.join(more, ["combo", "value"])
    apart = F.bit_count((F.col("a.pattern").bitwiseXOR(F.col("b.pattern"))).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask")))
    pairs = head.alias("a").join(head.alias("b"), ["combo", "value"]).where((F.col("a.block") < F.col("b.block")) & (apart <= NEAR))
    pairs = pairs.select(F.col("a.block").alias("block_a"), F.col("b.block").alias("block_b"))
    data = cells.select("block", "fps")
    pairs = pairs.join(data.toDF("block_a", "fps_a"), "block_a").join(data.toDF("block_b", "fps_b"), "block_b")
    kind = "u long, v long"
    return cells.select("fps").mapInPandas(within, kind).unionByName(pairs.select("fps_a", "fps_b").mapInPandas(between, kind))


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
    v = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def groups(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and per distinct fp its group (a fingerprint)."""
    rows = stored(with_fingerprints(docs), "simhash-rows")
    distinct = stored(rows.select("fp").distinct(), "simhash-distinct")
    linked = components(near_links(distinct, band_masks(distinct.count()), block))
    return rows, distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of the row's group; null if no row of it has an id."""
    rows, of = groups(docs, block)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(of, "fp")
    smallest = first.groupBy("group").agg(F.min("first").alias("component_id"))
    table = stored(first.select("fp", "group").join(smallest, "group").select("fp", "component_id"), "simhash-components")
    return rows.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their near-duplicates: of each group the row with the smallest doc_id stays, ids before null, repeated rows once."""
    rows, of = groups(docs)
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = rows.join(of, "fp").groupBy("group").agg(F.min(row).alias("r"))
    least = F.lit(-(2**63)).cast("long")
    kept = stored(kept.select(F.coalesce("r.doc_id", least).alias("_id"), F.col("r.text_hash").alias("_hash")), "simhash-kept")
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), least)).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    return keyed.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select(*docs.columns)
