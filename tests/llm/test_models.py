"""The two trained classifiers: gradients, marginals and held-out accuracy; what they do with odd input."""

import itertools
import zlib

import numpy as np
import pytest

from voc_spark.llm import quality_cnn as cnn
from voc_spark.llm import queries
from voc_spark.llm import toxicity_crf as crf

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op1_quality_classifier", "quality", 0.9), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy_and_every_document_scored(spark, name, label, least):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, FOLDER).collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [d for d in truth if got[d].held_out]
    assert sum(got[d].predicted == truth[d] for d in held) / len(held) >= least


def test_labels_outside_the_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "toxic", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - quality, quality) AS quality", "'x' AS text")
    a, b = (cnn.labelled_sample(docs, x, "quality", 50, 2000) for x in (labels, flipped))
    assert a == b and 0 < len(a) <= 50 and all(len(t) <= 2000 for t, _ in a)


# --- network ----------------------------------------------------------------
def test_gradient_is_the_slope_of_the_loss():
    model, r = cnn.new_model(), np.random.default_rng(1)
    model["bias"] += r.normal(size=cnn.FILTERS).astype(np.float32) / 20  # padding alone must not sit on the kink
    texts, labels = [b"", b"short", bytes(r.integers(32, 120, 1500, dtype=np.uint8)), b"ab " * 300], np.array([0.0, 1, 1, 0])
    loss = lambda: -np.mean(np.log(np.where(labels == 1, p := cnn.score_texts(model, texts), 1 - p)))
    grads = cnn.gradients(model, texts, labels)
    for name, at in (("head", (3,)), ("head", (30,)), ("bias", (5,)), ("filters", (0, 7, 4)), ("filters", (1, 32, 9)), ("embed", (97, 2)), ("out", (0,))):
        start, step = model[name][at].copy(), np.float32(5e-4)
        model[name][at] = start + step
        up = loss()
        model[name][at] = start - step
        down = loss()
        model[name][at] = start
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=0.1)


def test_chunks_cover_the_whole_text():
    """A pattern counts wherever it stands, on chunk and block borders too, and in any batch."""
    model, n = cnn.new_model(), cnn.CHUNK * 3 + 17
    alone = [cnn.score_texts(model, [bytes(32 for _ in range(n))[:at] + b"#$%&" * 2 + bytes(32 for _ in range(n - at))])[0] for at in range(cnn.CHUNK - 12, cnn.CHUNK + 12, 4)]
    assert max(alone) - min(alone) < 0.05 and max(alone) != cnn.score_texts(model, [b" " * (n + 8)])[0]
    texts = [b"a" * k for k in (0, 1, 511, 512, 513, 9000)]
    assert np.allclose(cnn.score_texts(model, texts), [cnn.score_texts(model, [t])[0] for t in texts])


def test_fit_is_repeatable_and_needs_two_labels():
    rows = [("### $$$ " * 20, 0), ("plain words in a line " * 8, 1)] * 20
    a, b = cnn.fit(rows, epochs=3), cnn.fit(rows, epochs=3)
    assert all((a[k] == b[k]).all() for k in a)
    assert cnn.score_texts(cnn.fit([("x", 1)]), [b"", b"y"]).tolist() == [0.5, 0.5]


def test_odd_documents_are_scored(odd_docs, no_docs):
    model = cnn.fit([("### $$$ " * 20, 0), ("plain words in a line " * 8, 1)] * 4, epochs=1)
    assert cnn.score(odd_docs, model).count() == 9 and cnn.score(no_docs, model).count() == 0
    same = [r.score for r in cnn.score(odd_docs, model).where("doc_id = 4").collect()]
    assert len(same) == 2 and same[0] == same[1]


# --- random field -----------------------------------------------------------
@pytest.mark.parametrize("n, seed", [(1, 0), (2, 1), (7, 2), (11, 3)])
def test_marginals_by_enumeration(n, seed):
    r = np.random.default_rng(seed)
    e, first, trans, start = r.normal(size=n) * 2, r.random(n) < 0.3, r.normal(size=(2, 2)), r.normal(size=2)
    first[0] = True
    total, pairs, z = np.zeros(n), np.zeros((2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(e[i] * y[i] + (start[y[i]] if first[i] else trans[y[i - 1], y[i]]) for i in range(n)))
        z += w
        total += w * np.array(y)
        for i in range(n):
            if not first[i]:
                pairs[y[i - 1], y[i]] += w
    p, q = crf.marginals(e, first, trans, start)
    assert np.allclose(p, total / z) and np.allclose(q, pairs / z)


def test_marginals_do_not_depend_on_the_batch():
    r = np.random.default_rng(5)
    parts = [r.normal(size=k) * 3 for k in (1, 400, 33, 2, 1000)]
    trans, start = np.log([[0.9, 0.1], [0.4, 0.6]]), np.log([0.8, 0.2])
    first = np.concatenate([np.arange(len(p)) == 0 for p in parts])
    joined, _ = crf.marginals(np.concatenate(parts), first, trans, start)
    assert np.allclose(joined, np.concatenate([crf.marginals(p, np.arange(len(p)) == 0, trans, start)[0] for p in parts]))


@pytest.fixture(scope="module")
def field():
    clean = ["the day was long and I saw you where the road was quiet %d" % i for i in range(60)]
    toxic = ["the day was long you idiot and the road moron was quiet %d" % i for i in range(30)]
    return crf.fit([(t, 0) for t in clean] + [(t, 1) for t in toxic])


def test_spans_are_code_points_of_the_toxic_words(field):
    text = "é\U0001F600 漢 what an IDIOT, you\tmoron!"
    scores, spans = crf.Tagger(field).tag([text, "", "a quiet road"])
    assert [text[a:b] for a, b, _ in spans[0]] == ["IDIOT,", "moron!"] and spans[1:] == [[], []]
    assert scores[0] > 0.5 > max(scores[1:])


def test_a_long_clean_text_stays_clean(field):
    scores, _ = crf.Tagger(field).tag(["some other words " * 20_000, "fresh%d " * 5 % tuple(range(5))])
    assert max(scores) < 0.5


def test_field_without_labels():
    scores, spans = crf.Tagger(crf.fit([("a b", 1)])).tag(["a b", ""])
    assert max(scores) < 0.1 and spans == [[], []]


def test_odd_documents_are_tagged(odd_docs, no_docs, field, spark):
    assert crf.score(odd_docs, field).count() == 9 and crf.score(no_docs, field).count() == 0
    kept = crf.without_toxic(odd_docs, field)
    assert kept.columns == odd_docs.columns and kept.count() == 9 and crf.without_toxic(no_docs, field).count() == 0
    assert crf.without_toxic(spark.createDataFrame([(1, "you idiot"), (2, "a quiet road")], "doc_id long, text string"), field).first().doc_id == 2
