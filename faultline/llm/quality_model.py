"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Method
    Tokens are runs of letters, digits or symbols; capitals and numbers share a token by length. Tokens are hashed to
    ``BUCKETS`` rows. Each row has a sparse random index vector; a row's context vector is the sum of the index
    vectors of its neighbours up to ``REACH`` places away, over all documents (each partition sums its own, and the
    sums are added by row). A document is what its tokens' vectors pool to: their mean with common tokens weighing less,
    their plain mean, their spread, and the mean product of neighbours; nothing else is known of it. A network of one
    hidden layer is trained in numpy on
    at most ``SAMPLE`` labelled rows of either class, none of them held out; a temperature fitted on a part of them
    that training leaves out calibrates its probabilities.

Cases
    Null or empty text: the vector of no tokens, a score like any other. No usable labels, or labels of one class:
    every score is 0.5. Empty table: no rows. Repeated rows are scored alike; a null doc_id is scored and never learned
    from. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._labels import held_out, labelled, sampled, training_sample
from faultline.llm._store import bounded_batches
from faultline.llm._text import Words, mix, words_of

BUCKETS, DIM, NONZERO, REACH = 8192, 32, 4, 2
SAMPLE = 8000
CUTOFF = 0.7
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
_SMOOTH = 1e-3

# Byte classes: white space, letters (and bytes of other scripts), digits, symbols, ends of lines.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2

_random = np.random.default_rng(20)
_PLACES = _random.integers(0, DIM, (BUCKETS, NONZERO))
_SIGNS = _random.choice([-1, 1], (BUCKETS, NONZERO))
#: Numbers of a document: four poolings of its tokens' vectors.
POOLED = 4 * DIM


def buckets(w: Words) -> np.ndarray:
    """The row of each token. Tokens in capitals, numbers and long runs of symbols share rows by length."""
    h = (mix(w.hash) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64
    first, last = w.data[w.start], w.data[w.end - 1]
    size = np.minimum(w.end - w.start, 15)
    capitals = (first >= 0x41) & (first <= 0x5A) & (last >= 0x41) & (last <= 0x5A) & (size > 1)
    h = np.where(capitals, 16 + size, h)
    return np.where(_CLASS[first] == 2, 32 + size, h)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, w in words_of(batch.column(0), _CLASS, fold=False):
            b = buckets(w)
            row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
            counts += np.bincount(b, minlength=BUCKETS)
            for reach in range(1, REACH + 1):
                near = row[reach:] == row[:-reach]
                left, right = b[:-reach][near], b[reach:][near]
                for one, other in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        sums += np.bincount(one * DIM + _PLACES[other, j], weights=_SIGNS[other, j], minlength=BUCKETS * DIM)
    used = np.flatnonzero(counts)
    values = sums.reshape(BUCKETS, DIM)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(np.ascontiguousarray(values[:, d])) for d in range(DIM))], ["bucket", "n", *(f"d{d}" for d in range(DIM))])


class Vectors(NamedTuple):
    """Unit word vectors and the weight of each row in a mean."""

    vectors: np.ndarray
    weights: np.ndarray


def word_vectors(docs: DataFrame) -> Vectors:
    """From all documents. What comes to the driver is BUCKETS rows, whatever the input."""
    columns = ["n", *(f"d{d}" for d in range(DIM))]
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_context_sums, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    rows = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    counts, vectors = np.zeros(BUCKETS), np.zeros((BUCKETS, DIM))
    at = rows.column("bucket").to_numpy()
    counts[at] = rows.column("n").to_numpy()
    for d in range(DIM):
        vectors[at, d] = rows.column(f"d{d}").to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = counts / max(counts.sum(), 1)
    return Vectors(vectors.astype(np.float32), (_SMOOTH / (_SMOOTH + share)).astype(np.float32))


def pooled(column: pa.Array, words: Vectors) -> np.ndarray:
    """A row of POOLED numbers for each text; one without tokens has zeros."""
    out = np.zeros((len(column), POOLED))
    for low, high, w in words_of(column, _CLASS, fold=False):
        b = buckets(w)
        n = np.diff(w.bounds)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        at, size = w.bounds[:-1][full], n[full][:, None]
        vectors, weights = words.vectors[b], words.weights[b][:, None]
        neighbours = np.zeros_like(vectors)
        neighbours[:-1] = vectors[:-1] * vectors[1:]
        neighbours[w.bounds[1:][full] - 1] = 0  # the next token is another text's
        total = lambda x: np.add.reduceat(x, at, axis=0, dtype=np.float64)
        mean = total(vectors) / size
        spread = np.sqrt(np.maximum(total(vectors * vectors) / size - mean * mean, 0))
        out[low:high][full] = np.concatenate((total(vectors * weights) / np.maximum(total(weights), 1e-9), mean, spread, total(neighbours) / size), axis=1)
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Two layers by Adam; classes weigh as in ``prior`` (the share of label 1 among all labelled rows)."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    cut = max(1, len(y) // 5)
    check, own = order[:cut], order[cut:]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    p = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        random.shuffle(own)
        for i in range(0, len(own), 128):
            rows = own[i : i + 128]
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = weight[rows] * (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            back = g[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(0), h.T @ g + DECAY * p[2], g.sum(keepdims=True)]
            step += 1
            for k, d in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits = net.logits(x[check])

    def loss(t: float) -> float:
        s = np.clip(logits / t, -40, 40)
        return float(np.sum(weight[check] * (np.log1p(np.exp(-s)) + (1 - y[check]) * s)))

    return net._replace(temperature=min(np.geomspace(0.25, 8, 61), key=loss))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, one row a row of ``docs``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = training_sample(labels, "quality", per_class)
    words, net = None, None
    if len({label for _, label in sample}) == 2:
        words = word_vectors(docs)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = pooled(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

        rows = sampled(docs, sample).mapInArrow(features, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
        if len(set(rows.column("label").to_pylist())) == 2:
            prior = labelled(labels, "quality").agg(F.avg("label")).first()[0]
            x = np.array(rows.column("x").to_pylist())
            net = train_network(x, rows.column("label").to_numpy().astype(float), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.probability(pooled(batch.column(1), words)) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
