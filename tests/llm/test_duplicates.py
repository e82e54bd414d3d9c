"""SimHash groups, repeated passages, benchmark leaks and the pipeline against brute force."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from voc_spark.llm import compact_windows as cw
from voc_spark.llm import decontaminate as dc
from voc_spark.llm import graph, queries, simhash
from voc_spark.sources.parquet import stored

FOLDER = "/root/testdata/sf0.001"


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_pairs(fps):
    fps = np.array(fps, np.uint64)
    return [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)]


# --- SimHash ----------------------------------------------------------------
def python_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_whole_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op7_simhash(spark, FOLDER).collect()
    ids = sorted(docs)
    fps = [python_fingerprint(docs[i]) for i in ids]
    group = {i: ids[r] for i, r in zip(ids, roots(len(ids), near_pairs(fps)))}
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (f, group[i]) for i, f in zip(ids, fps)} and len(got) == len(ids)


@pytest.fixture(scope="module")
def fingerprints():
    """Random ones, small families, and one dense family of 800."""
    r, out = random.Random(1), set()
    for size in [1, 2, 5, 30] * 12:
        base = r.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(r.randint(0, 8)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    base = r.getrandbits(64)
    while len(out) < 1200:
        x = base
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(18)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("block", [32, 2048])
@pytest.mark.parametrize("n", [1000, 10**9])
def test_index_loses_no_link(spark, fingerprints, block, n):
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fingerprints], "fp long")
    links = simhash.near_links(df, simhash.band_masks(n), block)
    assert links.count() < 64 * len(fingerprints) * 36
    root = {r.node: r.root for r in graph.components(links).collect()}
    groups = defaultdict(set)
    for x in fingerprints:
        s = int(np.uint64(x).view(np.int64))
        groups[root.get(s, s)].add(x)
    want = defaultdict(set)
    for x, r in zip(fingerprints, roots(len(fingerprints), near_pairs(fingerprints))):
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_odd_documents_are_grouped(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 9
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {1, 2, 3} and {r.component_id for r in blank} == {1}
    assert next(r for r in got if r.doc_id is None).component_id is None
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "7", "None"]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + k: 1000 for k in range(300)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- repeated passages ------------------------------------------------------
@pytest.mark.parametrize("seed", range(4))
def test_compact_windows_cover_each_subsequence_once(seed):
    r = np.random.default_rng(seed)
    h, width = r.integers(0, 40 if seed % 2 else 10**9, 60).astype(np.uint64), 7
    windows = cw.compact_windows(h, width)
    for i in range(len(h)):
        for j in range(i + width - 1, len(h)):
            hit = [c for lo, c, hi in windows if lo <= i <= c <= j <= hi]
            assert len(hit) == 1 and h[hit[0]] == h[i:j + 1].min()


@pytest.fixture(scope="module")
def passages(spark):
    """Random texts; a passage of 60 words in every third one, an edited copy, exact copies, and a passage too short to count."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, short, rows = words(60), words(40), []
    for i in range(90):
        body = words(r.randint(20, 300))
        at = r.randrange(len(body))
        part = shared if i % 3 == 0 else short if i % 3 == 1 else []
        rows.append((i, " ".join(body[:at] + part + body[at:])))
    whole = words(400)
    edited = list(whole)
    for at in (50, 200, 350):
        edited[at] = "changed"
    rows += [(100, " ".join(whole)), (101, " ".join(edited)), (102, " ".join(whole).upper()), (103, " ".join(whole))]
    return spark.createDataFrame(rows + [(None, " ".join(shared)), (104, None), (105, "")], "doc_id long, text string"), rows, shared


@pytest.mark.parametrize("parts", ["3", "40"])
def test_passages_by_brute_force(spark, passages, parts):
    df, rows, shared = passages
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = cw.passages(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    words = {i: cw.words_of(t) for i, t in rows}
    grams = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    for r in got:
        a, b = words[r.doc_a][r.a_from:r.a_to], words[r.doc_b][r.b_from:r.b_to]
        x, y = grams(a), grams(b)
        assert min(len(a), len(b)) >= 50 and r.similarity == pytest.approx(len(x & y) / len(x | y)) and r.similarity >= 0.8
    ids = sorted(words)
    at = {d: k for k, d in enumerate(ids)}
    found = roots(len(ids), [(at[r.doc_a], at[r.doc_b]) for r in got])
    held = [at[i] for i in range(0, 90, 3)]
    assert len({found[k] for k in held}) == 1 and len({found[at[d]] for d in (100, 101, 102, 103)}) == 1
    in_result = {d for r in got for d in (r.doc_a, r.doc_b)}
    assert in_result == {*range(0, 90, 3), 100, 101, 102, 103}
    assert len(got) < 10 * len(in_result)  # not all pairs


@pytest.mark.parametrize("parts", ["4", "40"])
def test_large_group_of_edited_copies_is_one_class(spark, parts):
    """Half of the copies have one word changed, so each is similar enough to the other half. The hash functions may miss 1 %."""
    r, rows, copies = random.Random(5), [], 3000
    shared = [f"s{k}" for k in range(60)]
    for d in range(copies):
        own = list(shared)
        if r.random() < 0.5:
            own[r.randrange(60)] = f"e{r.randrange(10**9)}"
        out = [[f"w{r.randrange(10**9)}" for _ in range(r.randint(5, 40))] for _ in range(2)]
        rows.append((d, " ".join(out[0] + own + out[1])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = cw.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    found = roots(copies, {(r.doc_a, r.doc_b) for r in got})
    assert len(got) < 10 * copies and copies - max(map(found.count, set(found))) <= copies // 100


def test_edited_passage_inside_a_longer_run():
    """80 words with one changed are similar enough, the 60 after them with every tenth changed are not, nor is the whole."""
    a = [f"w{k}" for k in range(140)]
    b = [f"x{k}" if k == 40 or k > 80 and k % 10 == 5 else w for k, w in enumerate(a)]
    got = cw.verify(a, b)
    assert got and min(r[0] for r in got) == 0 and max(r[1] for r in got) >= 80 and all(r[4] >= 0.8 for r in got)
    swapped = cw.verify(a[::-1], b[::-1])
    assert swapped and max(r[1] for r in swapped) == 140 and min(r[0] for r in swapped) <= 60


@pytest.mark.parametrize("seed", range(20))
def test_parts_of_a_run_cover_all_that_is_similar(seed):
    r = random.Random(seed)
    a = [f"w{k}" for k in range(200)]
    b = [w if r.random() > (0.01, 0.08)[k // 40 % 2] else f"x{k}" for k, w in enumerate(a)]
    grams = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    got, share = cw.verify(a, b), lambda x, y: len(x & y) / len(x | y)
    for a0, a1, b0, b1, similarity in got:
        assert min(a1 - a0, b1 - b0) >= 50 and similarity == pytest.approx(share(grams(a[a0:a1]), grams(b[b0:b1]))) and similarity >= 0.8
    held = [a[k:k + 5] == b[k:k + 5] for k in range(196)]
    split = [k for k in range(196 - cw.GAP) if not any(held[k:k + cw.GAP])]  # no passage reaches over so many changed shingles
    for lo in range(150):
        for hi in range(lo + 50, 201):
            if held[lo] and held[hi - 5] and not any(lo < k < hi - 5 for k in split) and share(grams(a[lo:hi]), grams(b[lo:hi])) >= 0.8:
                assert all(any(x[0] <= w < x[1] for x in got) for w in (lo, (lo + hi) // 2, hi - 1))


def test_passage_repeated_inside_documents(spark):
    """Every occurrence belongs to the class of its passage, whether or not another document holds it."""
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    one, two, rows, places = words(60), words(70), [], defaultdict(set)
    for d, passage, times in ((1, one, 12), (2, one, 1), (3, one, 3), (4, two, 9), (5, words(60), 1)):
        body = words(30)
        for _ in range(times):
            places[" ".join(passage)].add((d, len(body)))
            body += passage + words(r.randint(20, 90))
        rows.append((d, " ".join(body)))
    again = words(55)
    rows.append((6, " ".join(again * 6)))
    got = cw.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {d: t.split() for d, t in rows}
    at = {}
    for x in got:
        assert x.doc_a < x.doc_b or x.doc_a == x.doc_b and x.a_to <= x.b_from
        for d, lo, hi in ((x.doc_a, x.a_from, x.a_to), (x.doc_b, x.b_from, x.b_to)):
            for passage, held in places.items():
                n = len(passage.split())
                at |= {(d, lo, hi): (d, p) for e, p in held if e == d and min(hi, p + n) - max(lo, p) >= 50}
    for passage, held in places.items():
        ids = sorted(held)
        links = [(ids.index(u), ids.index(v)) for x in got if (u := at.get((x.doc_a, x.a_from, x.a_to))) in held and (v := at.get((x.doc_b, x.b_from, x.b_to))) in held]
        assert len(held) == 1 or len(set(roots(len(ids), links))) == 1
    assert {w for x in got if x.doc_a == 6 for w in [*range(x.a_from, x.a_to), *range(x.b_from, x.b_to)]} == set(range(len(texts[6])))


def test_links_between_documents_far_apart_in_a_run(spark):
    """All documents share 46 words, too few for a passage, so their windows stand in the same runs in order of doc_id; copies are 40 rows apart."""
    r = random.Random(580)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common = words(46)
    texts = [" ".join(words(5) + common + words(5)) for _ in range(40)]
    got = cw.passages(spark.createDataFrame([(d, texts[d % 40]) for d in range(80)], "doc_id long, text string")).collect()
    assert sorted((x.doc_a, x.doc_b) for x in got) == [(d, d + 40) for d in range(40)]


def test_odd_documents_have_no_passages(odd_docs, no_docs):
    assert cw.passages(odd_docs).count() == 0 and cw.passages(no_docs).count() == 0


# --- benchmark leaks --------------------------------------------------------
def brute_leaks(text, items):
    codes, out = dc.codes_of(text).tolist(), set()
    for i, t in items:
        item = dc.codes_of(t).tolist()
        n, most = len(item), dc.allowed(len(item))
        if n >= dc.LEAST_WORDS and any(dc.edit_distance(codes[s:s + n], item, most) <= most for s in range(len(codes))):
            out.add(i)
    return out


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        most = r.randint(0, 6)
        assert dc.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_edited_items_are_found_at_the_target_recall(spark):
    r = random.Random(2)
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs, truth = [], {}
    for k in range(240):
        i, text = r.choice(items)
        w = text.split()
        for _ in range(r.randint(0, dc.allowed(len(dc.codes_of(text))) + 2)):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at:at + (kind != 1)] = [] if kind == 2 else [f"new{r.randrange(10**6)}"]
        body = [f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 60))]
        at = r.randint(0, len(body))
        docs.append((k, " ".join(body[:at] + w + body[at:])))
        truth[k] = brute_leaks(docs[-1][1], items)
    got = defaultdict(set)
    for row in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[row.doc_id].add(row.item_id)
        assert row.edits <= 12 and row.start < row.end
    total, hit = sum(map(len, truth.values())), sum(len(truth[k] & got[k]) for k in truth)
    assert total > 100 and hit / total >= dc.RECALL and all(got[k] <= truth[k] for k in truth)


def test_whole_query_by_brute_force_leaks(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()][:60]
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, FOLDER).collect()}
    assert {(d, i) for d, t in docs for i in brute_leaks(t, items)} == {(d, i) for d, i in got if d in dict(docs)}


def test_odd_documents_and_items(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, None), (None, "a b c d e f"), (2, "a b"), (3, "same text twice"), (4, "word word word word word word"), (4, "word word word word word word"), (5, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(odd_docs, items).collect()} == {(7, 4)}
    kept = dc.without_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 7").count() == 0 and kept.count() == 8
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(odd_docs, none).count() == 0 and dc.without_leaks(odd_docs, none).count() == 9 and dc.leaks(no_docs, items).count() == 0
    many = spark.createDataFrame([(k, f"item number {k} has its own words w{k}") for k in range(30)], "item_id long, text string")
    assert sum(len(p) for p in dc.passes(many, 7)) == 30 and len(list(dc.passes(many, 7))) == 5


def test_search_compares_sets_and_skips_scattered_triples(monkeypatch):
    """Windows are compared with items by sets of words, repeats counted exactly, and a document that holds triples of items only far apart is not searched."""
    item = "the cat saw the dog and the cat saw the bird and then the cat went home again".split()
    index = dc.Index([(1, " ".join(item))])
    looked, verify = [], index._verify
    monkeypatch.setattr(index, "_verify", lambda *args: looked.append(len(args[1])) or verify(*args))
    far = [f"x{k}" for k in range(40)]
    assert index.search([" ".join(w for k in range(0, 18, 3) for w in item[k:k + 3] + far), None, ""]) == [[], [], []] and not sum(looked)
    monkeypatch.setattr(dc, "Counter", None)  # the words of windows were counted for every item they share a signature with
    monkeypatch.setattr(index, "_verify", lambda codes, starts, n, owner, best: None)
    assert index.search([" ".join(item)]) == [[]]
    monkeypatch.undo()
    edited = [w if k not in (4, 11) else "new" for k, w in enumerate(item)]
    assert index.search([" ".join(far + edited + far)])[0][0][::3] == (1, 2)


@pytest.mark.parametrize("word", ["The,", "--", "Ünïcode!", "«ÉA»", "x\x1fy", "a\u00a0b", "ΑΣ", "\ud800z", "…", "'tis"])
def test_codes_of_bytes(word):
    assert dc.byte_code(word.encode("utf-8", "surrogatepass")) == dc.word_code(word)
    text = f"{word} \t{word}\x0b{word}\x0c \r\n{word}\x1c\x85\u2003q"
    assert [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] == dc.WORDS.findall(text)


# --- pipeline ---------------------------------------------------------------
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, []
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, FOLDER), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        counts.append(docs.count())
        assert set(after) <= set(before) and counts[-1] == len(after)
        if name == "simhash_near_dedup":
            ids = sorted(before)
            groups = roots(len(ids), near_pairs([python_fingerprint(before[i]) for i in ids]))
            assert sorted(after) == sorted({ids[g] for g in groups})
        if name == "benchmark_decontamination":
            assert all(bool(brute_leaks(before[d], items)) == (d not in after) for d in list(before)[:50])
        if name != "pii":
            assert all(after[d] == before[d] for d in after)
        else:
            assert set(after) == set(before) and not any(re.search(r"\d+@mail\d", t) for t in after.values())
        if name != "mixing":
            assert docs.columns == columns
    total = docs.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(total[0] - 1.5 * total[1]) <= 20
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]


def test_pipeline_on_odd_documents(spark, odd_docs):
    """The labels know too few of them to call any toxic; blank ones are one group, the repeated row stays once."""
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "4", "5", "6", "7", "None"]


def test_passages_delete_tables_nothing_reads(spark, monkeypatch):
    """Windows and near links are gone when the result is returned, which reads as before."""
    made, stored = {}, cw.stored

    def noting(df, label, **options):
        out = stored(df, label, **options)
        made.setdefault(label, []).append(out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/"))
        return out

    monkeypatch.setattr(cw, "stored", noting)
    text = " ".join(f"w{i}" for i in range(80))
    got = cw.passages(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert [(r.doc_a, r.a_from, r.a_to, r.doc_b, r.b_from, r.b_to, r.similarity) for r in got] == [(1, 0, 80, 2, 0, 80, 1.0)]
    for label in ("compact-windows", "compact-links-near"):
        assert made[label] and not any(os.path.exists(path) for path in made[label])


def test_no_text_of_a_region_is_stored_or_shuffled(spark, monkeypatch):
    """40 documents share 34 words, too few for a passage: their regions are stored without text, and none gets as far as its shingles."""
    sent, stored = {}, cw.stored

    def noting(df, label, **options):
        out = stored(df, label, **options)
        sent.setdefault(label, []).append([bytes(r.sent or b"") for r in out.select("sent").collect()] if "sent" in out.columns else out.columns)
        return out

    monkeypatch.setattr(cw, "stored", noting)
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    short = words(34)  # too short for a passage, but candidates
    texts = [" ".join(words(20) + short + words(20)) for _ in range(40)]
    assert cw.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0
    assert any(sent["compact-regions"]) and all(not x for rows in sent["compact-regions"] for x in rows)
    assert not any(sent["compact-hopeful"])


@pytest.mark.parametrize("seed", range(6))
def test_hopeful_regions_keep_every_passage(seed):
    """Random edits, runs of one word and loops: where `verify` finds a passage the marks let the region pass."""
    r, kept, all_ = random.Random(seed), 0, 0
    for _ in range(300):
        loop = [f"l{k}" for k in range(r.randint(2, 12))]
        a = [w for _ in range(r.randint(1, 5)) for w in ([f"r{r.randrange(6)}"] * r.randint(5, 40) if r.random() < 0.4 else loop * 4 if r.random() < 0.2 else [f"w{k}" for k in range(r.randint(0, 40), 70)])]
        rate = r.choice((0.005, 0.02, 0.04, 0.3))
        b = [w if r.random() > rate else f"x{k}" for k, w in enumerate(a)]
        b = b[r.randint(0, 20):] + [f"y{k}" for k in range(r.randint(0, 30))]
        ga, gb = (cw.tokens(np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)) for w in (a, b))
        pass_ = cw.hopeful(np.unique(ga.astype(np.uint16)), gb)
        assert pass_ or not cw.verify(a, b)
        kept, all_ = kept + pass_, all_ + 1
    assert 0 < kept < all_


def test_repeated_ids_and_busy_documents(spark, monkeypatch):
    """One document in more regions than are read beside one copy of its text, and an id with two texts, of which the least piece counts."""
    monkeypatch.setattr(cw, "ASKED", 5)
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = words(60)
    rows = [(d, " ".join(words(10) + passage + words(10))) for d in range(40)]
    got = cw.passages(spark.createDataFrame(rows + rows[:7], "doc_id long, text string")).collect()
    assert len(set(roots(40, [(x.doc_a, x.doc_b) for x in got]))) == 1 and all(x.a_from == x.b_from >= 10 and x.a_to == x.b_to <= 70 for x in got)
    doc, known = cw.Text(), dc.Codes()
    doc.texts = ["b " * 60, "a " * 60]
    assert np.array_equal(doc.piece(0, 50, known), doc.pieces(0, 50, known)[1])


def test_second_round_in_passes(spark, monkeypatch):
    """Links between classes are made a share of the documents at a time, with the same result."""
    r = random.Random(580)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common = words(46)
    texts = [" ".join(words(5) + common + words(5)) for _ in range(40)]
    docs, made, regions = spark.createDataFrame([(d, texts[d % 40]) for d in range(80)], "doc_id long, text string"), [], cw.regions
    monkeypatch.setattr(cw, "PER_PASS", 4)
    monkeypatch.setattr(cw, "regions", lambda found, *more: made.append({x.a for x in found.select("a").distinct().collect()}) or regions(found, *more))
    got = cw.passages(docs).collect()
    assert sorted((x.doc_a, x.doc_b) for x in got) == [(d, d + 40) for d in range(40)]
    second = made[1:]
    assert len(second) > 3 and sum(map(len, second)) == len(set().union(*second)) > 40


def test_passages_inside_places_that_other_text_connects(spark):
    """Documents 2g and 2g + 1 are copies; all end in one passage, so all are connected there. Those of g and g + 20 begin with the same piece, in which all
    share 46 words: their windows stand far apart in the runs, and what connects the documents' ends says nothing about the piece."""
    r, rows = random.Random(580), []
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common, end = words(46), words(100)
    pieces = [words(5) + common + words(5) for _ in range(20)]
    for g in range(40):
        text = " ".join(pieces[g % 20] + words(30) + end)
        rows += [(2 * g, text), (2 * g + 1, text)]
    got = cw.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(min(x.a_to - x.a_from, x.b_to - x.b_from) >= 50 and x.similarity >= 0.8 for x in got)
    begun = {(x.doc_a // 2, x.doc_b // 2) for x in got if x.a_to <= 86 and x.b_to <= 86}
    assert begun == {(g, g + 20) for g in range(20)}


def test_a_repeat_inside_one_passage_is_no_place_of_the_other(spark):
    """Each link of two places that a passage holds connects them only if it is shifted like the passage; long passages connect in every block."""
    found = spark.createDataFrame(
        [(1, 2, 0, 10, 80, 10, 80, 40), (1, 2, 1, 10, 80, 90, 160, 40), (1, 2, 0, 500, 560, 500, 560, 530), (1, 3, 0, 10, 80, 10, 80, 40)],
        "a long, b long, k int, b_from int, b_to int, a_from int, a_to int, c int")
    checked = spark.createDataFrame([(1, 0, 600, 2, 0, 600, 1.0)], cw.FOUND)
    assert sorted((x.u.c, x.v.c) for x in cw.same_places(found, checked).collect()) == [(40, 40), (530, 530)]


def test_second_round_keeps_one_link_between_two_classes(spark):
    """Of two passages between the same classes the least stays, as does one between others; those inside a class or between classes that the first round
    connects go, one without shared shingles and one whose range no other holds whole stay."""
    rows = spark.createDataFrame(
        [(0, 7, d, 0, 20, 60, root, 20) for d, root in ((1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7))], "k int, value long, doc_id long, l int, c int, r int, root long, place int")
    found = [(1, 0, 60, 3, 0, 60, 1.0), (2, 0, 60, 4, 0, 60, 1.0), (1, 0, 60, 2, 0, 60, 1.0), (3, 0, 60, 5, 0, 60, 1.0), (1, 100, 160, 9, 0, 60, 1.0), (6, 0, 60, 7, 0, 60, 1.0), (2, 10, 90, 4, 10, 90, 1.0)]
    first = spark.createDataFrame([(1, 0, 60, 2, 0, 60, 1.0), (3, 0, 60, 4, 0, 60, 1.0), (6, 0, 70, 7, 0, 70, 1.0)], cw.FOUND)
    got = cw.one_each(spark.createDataFrame(found + found[:1], cw.FOUND), first, rows).collect()
    assert sorted((x.doc_a, x.a_from, x.doc_b) for x in got) == [(1, 0, 3), (1, 100, 9), (2, 10, 4), (3, 0, 5)]


def test_repeated_text_is_followed_at_the_shift_of_its_region():
    """Words 8 to 170 repeat every 32; the pieces are 96 apart, but the first shingle of b stands 32 words into a."""
    text = [f"x{k}" for k in range(8)] + [f"w{k % 32}" for k in range(8, 170)]
    got = cw.verify(text[:74], text[96:170], ahead=96)
    assert [r[:4] for r in got] == [(8, 74, 8, 74)] and got[0][4] == 1.0
