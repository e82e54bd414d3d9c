"""Quality score by a byte-level convolutional network in numpy.

A document's bytes are embedded and cut into overlapping chunks that together cover all of it: each chunk holds the
filter windows that start in it, and the last ones reach into the next chunk. Beside the embedded bytes the filters see an echo
channel, how much of the last bytes stood there already a word's length before. Filter responses are max-pooled per chunk;
the document's maximum and mean over chunks feed one logistic unit. Fitting needs the gradient at each chunk's
best window only. Scoring is a map over the table: no shuffle, memory bounded by a block of bytes.

A null text is an empty one; empty texts are one chunk of padding and get a score too. Repeated rows are scored alike, each on its
own; without any usable label every score is 0.5. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voc_spark.llm.common import carry, held_out, labelled_sample, pick

#: Bytes per step, steps per filter, bytes per chunk, embedding size, filters.
STRIDE, REACH, CHUNK, DIM, FILTERS = 4, 2, 512, 8, 24
#: Distances of the echo, and the steps that it is averaged over.
LAGS, ECHO_STEPS = range(2, 25), 8
WIDTH = STRIDE * DIM + 1
APART = STRIDE * (REACH + ECHO_STEPS) + max(LAGS)
#: Labelled documents for fitting, and the longest of them in characters.
FIT_ROWS, FIT_CHARS = 3_000, 12_000
BLOCK_BYTES = 1 << 18

carry(__name__)


def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    model = {"embed": f32(256, DIM, scale=0.5), "filters": f32(REACH, WIDTH, FILTERS, scale=0.15),
             "bias": np.zeros(FILTERS, np.float32), "head": f32(2 * FILTERS, scale=0.1), "out": np.zeros(1, np.float32)}
    model["embed"][0] = 0  # padding
    return model


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text from a chunk boundary on, with so many zeros behind it that no echo of the next one reaches it; chunks per text."""
    counts = np.array([-(-(len(t) + APART) // CHUNK) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()) + 1) * CHUNK, np.uint8)  # the spare chunk is what the last windows reach into
    at = 0
    for t, n in zip(texts, counts):
        out[at:at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * CHUNK
    return out, counts


def echo(data: np.ndarray) -> np.ndarray:
    """Per step of STRIDE bytes: share of the last ECHO_STEPS steps that repeat, at one of the LAGS, what stood before."""
    back = np.concatenate([np.zeros(32, np.uint8), data])
    now = data.view(np.uint32)
    same = np.zeros(len(now), bool)
    for lag in LAGS:
        same |= now == np.frombuffer(back.data, np.uint32, len(now), 32 - lag)
    total = np.cumsum(np.concatenate([np.zeros(ECHO_STEPS, np.int64), same & (now != 0)]))
    return ((total[ECHO_STEPS:] - total[:-ECHO_STEPS]) / ECHO_STEPS).astype(np.float32)


def responses(model: dict[str, np.ndarray], data: np.ndarray, echoes: np.ndarray) -> np.ndarray:
    """(chunks, windows per chunk, filters) before the bias."""
    steps = np.empty((len(data) // STRIDE, WIDTH), np.float32)
    steps[:, :-1] = model["embed"][data].reshape(-1, STRIDE * DIM)
    steps[:, -1] = echoes
    n = len(steps) - CHUNK // STRIDE
    total = steps[:n] @ model["filters"][0]
    for k in range(1, REACH):
        total += steps[k:n + k] @ model["filters"][k]
    return total.reshape(-1, CHUNK // STRIDE, FILTERS)


def pooled(model: dict[str, np.ndarray], data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(chunks, filters), computed block by block."""
    parts = [x.max(axis=1) for x in blocks(model, data, echo(data), counts)]
    return np.maximum(np.concatenate(parts) + model["bias"], 0)


def blocks(model: dict[str, np.ndarray], data: np.ndarray, echoes: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.zeros(len(data) // CHUNK - 1, bool)
    ends[np.cumsum(counts) - 1] = True
    chunks, step, each = len(data) // CHUNK - 1, max(1, BLOCK_BYTES // CHUNK), CHUNK // STRIDE
    for a in range(0, chunks, step):
        b = min(a + step, chunks) + 1
        out = responses(model, data[a * CHUNK:b * CHUNK], echoes[a * each:b * each])
        out[ends[a:b - 1], 1 - REACH:] = -np.inf  # these would reach into the next text
        yield out


def features(chunk_values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.hstack([np.maximum.reduceat(chunk_values, first, axis=0), np.add.reduceat(chunk_values, first, axis=0) / counts[:, None]])


def score_texts(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, counts = padded(texts)
    z = features(pooled(model, data, counts), counts) @ model["head"] + model["out"][0]
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fit(rows: list[tuple[str, int]], epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 5) -> dict[str, np.ndarray]:
    """Log loss by Adam; the same rows give the same model. Rows of fewer than two labels give the constant model."""
    model = new_model(seed)
    if len({y for _, y in rows}) < 2:
        return {k: np.zeros_like(v) for k, v in model.items()}
    texts, labels = [(t or "").encode("utf-8") for t, _ in rows], np.array([y for _, y in rows], float)
    model["out"][0] = np.log(labels.mean() / (1 - labels.mean()))
    r, moments, t = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}, 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        turn = r.permutation(len(texts))
        for a in range(0, len(texts), batch):
            t += 1
            some = turn[a:a + batch]
            grads = gradients(model, [texts[i] for i in some], labels[some])
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                step = rate * (1 - t / (total + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
                model[k] -= step.astype(np.float32)
            model["embed"][0] = 0
    return model


def gradients(model: dict[str, np.ndarray], texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    data, counts = padded(texts)
    best, top, chunks, echoes = [], [], len(data) // CHUNK - 1, echo(data)
    for x in blocks(model, data, echoes, counts):
        best.append(x.argmax(axis=1))
        top.append(x.max(axis=1))
    best, raw = np.concatenate(best), np.concatenate(top) + model["bias"]
    value = np.maximum(raw, 0)
    x = features(value, counts)
    z = np.clip(x @ model["head"] + model["out"][0], -30, 30)
    dz = (1 / (1 + np.exp(-z)) - labels) / len(labels)
    dx = dz[:, None] * model["head"][None, :]
    doc = np.repeat(np.arange(len(texts)), counts)
    is_top = value >= x[doc, :FILTERS]
    alike = np.add.reduceat(is_top.astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)  # chunks that tie share the gradient
    dv = dx[doc, FILTERS:] / counts[doc, None] + np.where(is_top, dx[doc, :FILTERS] / alike[doc], 0)
    dv = np.where(raw > 0, dv, 0).astype(np.float32)
    at = np.arange(chunks)[:, None] * CHUNK + best * STRIDE  # first byte of the best window, (chunks, filters)
    window = data[at[..., None] + np.arange(STRIDE * REACH)]  # (chunks, filters, bytes)
    seen = np.empty((chunks, FILTERS, REACH, WIDTH), np.float32)
    seen[..., :-1] = model["embed"][window].reshape(chunks, FILTERS, REACH, STRIDE * DIM)
    seen[..., -1] = echoes[at[..., None] // STRIDE + np.arange(REACH)]
    d_filters = np.einsum("cf,cfkd->kdf", dv, seen, optimize=True)
    d_seen = np.einsum("cf,kdf->cfkd", dv, model["filters"], optimize=True)[..., :-1].reshape(-1, DIM)
    d_embed = np.stack([np.bincount(window.ravel(), d_seen[:, j], 256) for j in range(DIM)], axis=1)
    return {"embed": d_embed.astype(np.float32), "filters": d_filters, "bias": dv.sum(axis=0),
            "head": (x.T @ dz).astype(np.float32), "out": np.array([dz.sum()], np.float32)}


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> dict[str, np.ndarray]:
    return fit(labelled_sample(docs, labels, "quality", rows, max_chars))


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out and score of each row of (doc_id, text)."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, scores, some, size = b.column("text"), [], [], 0
            for i in range(b.num_rows):
                t = texts[i].as_py()
                some.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    scores.append(score_texts(model, some))
                    some, size = [], 0
            scores.append(score_texts(model, some))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
