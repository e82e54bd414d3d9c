"""Chat formatting as a prefix tree: turns that conversations share from their start on are written once.

Conversations become paths of turns; each turn is named by a hash of everything up to it. Runs of turns that the
same conversations share are one segment (a radix tree), so paths are as long as the tree branches, not as the
conversations are. Segments are emitted depth-first: sorted by path over ranges, each with its offset in the packed
stream, the position ids of its characters (counted along its own path) and the intervals of the stream that it may
attend to, its ancestors.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Inside roles and texts a backslash is doubled, `<|` becomes
`<\\|` and, in roles, a newline `\\n`, so no control string can arise and all of it can be undone. Positions count code points.

Null texts and roles are empty; a null turn comes first; turns with equal numbers are ordered by role and text, repeated rows stay
repeated turns; rows without conv_id are one conversation. An empty table gives empty frames; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voc_spark.llm.common import pick
from voc_spark.sources.parquet import stored

START, END = "<|im_start|>", "<|im_end|>"
ROOT = "-"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column) -> Column:
    """Undoes `escape` in one pass from the left: pairs of a backslash and what it stands for."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1))
    plain = lambda p: F.when(p == "\\n", "\n").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(pieces, plain), "")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role, True), F.lit("\n"), escape(text), F.lit(END + "\n"))


class ChatTree(NamedTuple):
    #: segment, path (segments from the root), text, n_chars, turns of (role, loss, start in the segment, head, length),
    #: stream_start, position (of its first character along the path), attends (array of stream intervals, end exclusive), conversations
    segments: DataFrame
    #: conv_id, n_turns, path
    members: DataFrame


def build(rows: DataFrame) -> ChatTree:
    """The tree of all conversations in (conv_id, turn, role, text)."""
    rows = pick(rows, conv_id="long", turn="long", role="string", text="string")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"], t["text"]))
    chained = F.aggregate(
        "turns", F.array().cast("array<string>"),
        lambda done, t: F.array_append(done, F.sha2(F.concat_ws("\n", F.coalesce(F.element_at(F.concat(F.array(F.lit(ROOT)), done), -1)), format_turn(t["role"], t["text"])), 256)))
    convs = stored(rows.groupBy("conv_id").agg(turns.alias("turns")).withColumn("nodes", chained), "chat-convs")

    nodes = convs.select("conv_id", F.posexplode("nodes").alias("k", "node"))
    shared = stored(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "chat-shared")
    counts = nodes.join(shared, "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("shared"))
    # Shared turns are a prefix of each conversation; behind them every count is 1. A segment ends where the count changes.
    joined = convs.join(counts.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    count_at = lambda k: F.coalesce(F.get("shared", k)["n"], F.lit(1))
    ends = F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda k: (k == F.size("nodes") - 1) | (count_at(k) != count_at(k + 1)))
    cut = joined.withColumn("ends", ends).select(
        "conv_id", F.size("turns").alias("n_turns"), "turns",
        F.transform("ends", lambda e, i: F.struct(
            F.get("nodes", e).alias("segment"), count_at(e).alias("conversations"),
            F.when(i == 0, 0).otherwise(F.get("ends", i - 1) + 1).alias("first"), e.alias("last"))).alias("cuts"))
    cut = cut.withColumn("path", F.transform("cuts", lambda c: c["segment"]))
    members = cut.select("conv_id", "n_turns", "path")

    pieces = cut.select("turns", "path", F.posexplode("cuts").alias("k", "c")).select(
        "c.segment", "c.conversations", F.slice("path", 1, F.col("k") + 1).alias("path"),
        F.expr("slice(turns, c.first + 1, c.last - c.first + 1)").alias("turns"))
    # A segment of one conversation is there once already; only shared ones have copies to drop.
    once = pieces.where("conversations = 1").unionByName(pieces.where("conversations > 1").dropDuplicates(["segment"]))
    formatted = once.withColumn("formatted", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), (t["role"] == "assistant").alias("loss"), format_turn(t["role"], t["text"]).alias("text"),
        (F.length(escape(t["role"], True)) + len(START) + 1).alias("head"), F.length(escape(t["text"])).alias("length"))))
    formatted = formatted.withColumn("text", F.array_join(F.transform("formatted", lambda t: t["text"]), ""))
    places = F.aggregate(
        "formatted", F.struct(F.array().cast("array<struct<role:string,loss:boolean,start:int,head:int,length:int>>").alias("all"), F.lit(0).alias("at")),
        lambda a, t: F.struct(
            F.array_append(a["all"], F.struct(t["role"].alias("role"), t["loss"].alias("loss"), (a["at"] + t["head"]).alias("start"), t["head"].alias("head"), t["length"].alias("length"))).alias("all"),
            (a["at"] + F.length(t["text"])).alias("at")))
    formatted = formatted.select("segment", "path", "conversations", "text", F.length("text").alias("n_chars"), places["all"].alias("turns"))

    ranged = stored(formatted.repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "chat-ranged")
    before = Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.sum("n_chars").alias("_n"))  # one row per range
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    placed = ranged.select("segment", "path", "n_chars", "_part", F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("_in")).join(parts, "_part")
    placed = stored(placed.select("segment", "path", "n_chars", (F.col("_offset") + F.col("_in")).alias("stream_start")), "chat-placed")
    spans = placed.select(F.col("segment").alias("ancestor"), F.struct("stream_start", (F.col("stream_start") + F.col("n_chars")).alias("stream_end")).alias("span"))
    above = placed.select("segment", F.explode("path").alias("ancestor")).where("segment != ancestor").join(spans, "ancestor")
    above = above.groupBy("segment").agg(F.sort_array(F.collect_list("span")).alias("attends"))
    length = F.aggregate("attends", F.lit(0).cast("long"), lambda a, s: a + s["stream_end"] - s["stream_start"])
    segments = (
        ranged.drop("_part", "path").join(placed.drop("n_chars"), "segment").join(above, "segment", "left")
        .withColumn("attends", F.coalesce("attends", F.array().cast("array<struct<stream_start:bigint,stream_end:bigint>>")))
        .withColumn("position", length)
        .select("segment", "path", "text", "n_chars", "turns", "stream_start", "position", "attends", "conversations"))
    return ChatTree(segments, members)


def read_back(tree: ChatTree) -> DataFrame:
    """conv_id, n_turns, turns (role, text as they came in), loss_text, formatted: each conversation put together from its segments."""
    steps = tree.members.select("conv_id", F.posexplode("path").alias("k", "segment"))
    parts = steps.join(tree.segments.select("segment", "text", "turns"), "segment")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "text", "turns"))).alias("parts"))
    # No control string can stand inside an escaped text, so each end marker closes a turn.
    pieces = lambda p: F.filter(F.split(p["text"], r"<\|im_end\|>\n", -1), lambda x: x != "")
    turns = F.flatten(F.transform("parts", lambda p: F.transform(F.arrays_zip(pieces(p).alias("piece"), p["turns"].alias("turn")), lambda z: F.struct(
        unescape(F.substring(z["piece"], F.lit(len(START) + 1), z["turn"]["head"] - len(START) - 1)).alias("role"),
        unescape(F.substring(z["piece"], z["turn"]["head"] + 1, z["turn"]["length"])).alias("text"), z["turn"]["loss"].alias("loss")))))
    return whole.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "turns",
        F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "").alias("loss_text"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"))
