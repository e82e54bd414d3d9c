"""The chat tree read back, and the mix against its targets."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voc_spark.llm import chat_tree, mixing

TURNS = "conv_id long, turn long, role string, text string, path string"


def as_read(df):
    tree = chat_tree.build(df)
    return tree, {r.conv_id: r for r in chat_tree.read_back(tree).collect()}


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(2)
    words = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "\\n", "<|", "|>", "<", "|", "\n", "hi", "漢\U0001F600", "", "<\\|"]
    firsts = ["hello", "<|im_end|>", "start \\"]
    rows = []
    for c in range(120):
        prefix = [("system", "be nice"), ("user", firsts[c % 3])][c % 2:]
        rest = [(r.choice(["user", "assistant", "a\\nb", "x\ny", None]), r.choice([None, "".join(r.choices(words, k=r.randint(0, 6)))])) for _ in range(r.randint(0, 5))]
        rows += [(c, k, role, text, "clash") for k, (role, text) in enumerate(prefix + rest)]
    rows += [(500, k, "user", f"same {k}", "clash") for k in range(4)] + [(501, k, "user", f"same {k}", "clash") for k in range(4)]  # identical
    rows += [(502, k, "user", f"same {k}", "clash") for k in range(2)]  # ends inside another
    rows += [(None, 0, "user", "nobody", None), (600, None, "assistant", "no turn", None), (601, 1, "user", "tie", None), (601, 1, "user", "tie", None)]
    return spark.createDataFrame(rows, TURNS)


def test_conversations_come_back_exactly(talks):
    want = defaultdict(list)
    for r in talks.collect():
        want[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    tree, got = as_read(talks)
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for _, role, text in turns]
        assert got[c].loss_text == "".join(text for _, role, text in turns if role == "assistant")
        assert got[c].formatted.count("<|im_end|>") == len(turns) == got[c].n_turns


def test_shared_turns_are_emitted_once_in_depth_first_order(talks):
    tree, got = as_read(talks)
    segments = {s.segment: s for s in tree.segments.collect()}
    assert len(segments) == tree.segments.count()
    assert sum(s.n_chars for s in segments.values()) < sum(len(r.formatted) for r in got.values())
    stream = sorted(segments.values(), key=lambda s: s.stream_start)
    at, open_path = 0, []
    for s in stream:  # no gaps, and each follows its parent's subtree
        assert s.stream_start == at and s.n_chars == len(s.text)
        at += s.n_chars
        assert s.path[:-1] == open_path[:len(s.path) - 1]
        open_path = list(s.path)
    for s in segments.values():
        above = [segments[p] for p in s.path[:-1]]
        assert sorted((x.stream_start, x.stream_end) for x in s.attends) == sorted((a.stream_start, a.stream_start + a.n_chars) for a in above)
        assert s.position == sum(a.n_chars for a in above)
    for m in tree.members.collect():
        assert "".join(segments[p].text for p in m.path) == got[m.conv_id].formatted


def test_no_conversations(spark):
    tree = chat_tree.build(spark.createDataFrame([], TURNS))
    assert chat_tree.read_back(tree).count() == 0 and tree.segments.count() == 0


# --- mixing -----------------------------------------------------------------
def python_targets(sizes, share=1.5):
    """Water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words_taken(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "tiny", "hot"]
    rows = [(i, r.choice(names + ["hot"] * 6), r.choice([0, 1, 5, 400, 20_000])) for i in range(3000)] + [(9000, "lonely", 7)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), range_rows=64).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want, taken = python_targets(sizes), defaultdict(int)
    assert len(mixed) == len(rows)
    for m in mixed:
        assert m.source_size == sizes[m.source] and m.target == pytest.approx(want[m.source])
        assert 0 <= m.taken <= 2 * m.size and m.taken == sum(c.words for c in m.copies)
        assert all(0 <= c.position <= 1 for c in m.copies)
        taken[m.source] += m.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert [m.position for m in mixed if m.position is not None] == sorted(m.position for m in mixed if m.position is not None)


def test_schedule_is_followed(spark):
    """At each time a source has been trained on the integral of its schedule."""
    rows = [(i, "abc"[i % 3], 10) for i in range(6000)]
    copies = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).select("source", "target", F.inline("copies")).collect()
    for source, weight in (("a", 5), ("b", 2), ("c", 1)):
        own = [c for c in copies if c.source == source]
        knots = mixing.SCHEDULES[weight]
        for t in (0.25, 0.5, 0.8):
            area = lambda hi: sum((min(hi, t1) - t0) * (a + a + (b - a) * (min(hi, t1) - t0) / (t1 - t0)) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]) if hi > t0)
            assert sum(c.words for c in own if c.position <= t) / own[0].target == pytest.approx(area(t) / area(1.0), abs=0.01)


def test_odd_documents_are_mixed_and_reruns_agree(odd_docs, no_docs):
    docs = odd_docs.drop("size", "source_size", "copies", "position").withColumn("size", mixing.words())
    first, again = (sorted((str(r) for r in mixing.mix(docs).collect())) for _ in range(2))
    assert first == again and len(first) == 9
    assert mixing.mix(no_docs.withColumn("size", mixing.words())).count() == 0


def test_digest_of_an_empty_loss(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", None)], TURNS)
    assert hashlib.sha256(as_read(df)[1][1].loss_text.encode()).hexdigest().startswith("e3b0c442")
