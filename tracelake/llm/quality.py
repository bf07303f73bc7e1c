"""Quality classifier on random-indexing word vectors (operator 6).

Word vectors come from the whole corpus: each hashed word has a fixed sparse
ternary index vector, and a word's context vector is the sum of the index
vectors of its neighbours, rotated by their distance and side, over all
documents.  Words are runs of letters of either case, of digits or of other
signs, as they are written.  A document is pooled from its words' normalised
context vectors alone: their mean, their deviation, and the mean product of each
word's vector with the next one's.  A two-layer network scores that, and a
temperature fitted on rows kept from training calibrates the probability.

The vocabulary is hashed into ``BUCKETS`` rows, so vectors have a fixed size
(8 MB) whatever the corpus; partial sums of tasks are added in a streaming
pass by row range.  The network is fitted on the driver from the features of
at most ``most_labelled`` labelled documents; all else covers all documents.

Defined cases: null or empty text has no words and gets the network's score
for the zero vector; rows are scored by their text alone, so equal texts get
equal scores; labels that are null are ignored, several for one doc_id are
averaged; of rows that repeat a labelled doc_id the text of least hash is learnt
from; with no labels, fewer than ``LEAST_LABELLED`` or one class only, all
documents get the smoothed share of good labels; an empty table gives an empty
result; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

BUCKETS, DIM, ONES, ROWS, REACH, LEAST_LABELLED = 1 << 15, 64, 4, 256, 2, 20
#: Bytes are parted where this changes: 0 space, 1 line end, 2 letters and beyond ASCII, 3 digits, 4 other.
_KIND = np.full(256, 4, np.uint8)
_KIND[t.SPACE] = 0
_KIND[10] = 1
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 2
_KIND[0x30:0x3A] = 3


def _index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, DIM, (BUCKETS, ONES)), random.choice(np.array([-1, 1], np.int32), (BUCKETS, ONES))


def _pieces(x: t.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of like bytes, and the documents' bounds; spaces are left out."""
    if not len(x.data):
        return np.zeros(0, np.int64), np.zeros(x.n + 1, np.int64)
    kind = _KIND[x.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[x.offsets[:-1][np.diff(x.offsets) > 0]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    h = t.span_hash(t.prefix_hash(x.data), start, end)
    return (h % np.uint64(BUCKETS)).astype(np.int64), x.bounds(start)


def _context_sums(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors(seed)
        total, seen, any_ = np.zeros(BUCKETS * DIM, np.int32), np.zeros(BUCKETS, np.int32), False
        for batch in batches:
            for _, _, x in t.slices(batch.column("text"), t.SMALL):
                any_ = True
                b, bound = _pieces(x)
                seen += np.bincount(b, minlength=BUCKETS)
                doc = t.owner(bound)
                for k in range(1, REACH + 1):
                    same = doc[:-k] == doc[k:]
                    one, two = b[:-k][same], b[k:][same]
                    for turn, (word, other) in enumerate(((two, one), (one, two))):
                        turn = 7 * (k - 1) + 3 * turn  # each distance and side has a rotation of its own
                        for i in range(ONES):
                            np.add.at(total, word * DIM + (place[other, i] + turn) % DIM, sign[other, i])
        if any_:
            both = np.concatenate([total.reshape(BUCKETS, DIM), seen[:, None]], axis=1)
            for i in range(0, BUCKETS, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([both[i : i + ROWS].tobytes()])], ["first", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each row range as vectors of length 1, and how often each word was seen."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for first, sums in zip(batch.column("first").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(sums, np.int32).astype(np.int64)
            total[first] = total[first] + x if first in total else x
    units, seen = [], []
    for x in total.values():
        both = x.reshape(ROWS, DIM + 1)
        length = np.linalg.norm(both[:, :DIM], axis=1, keepdims=True)
        units.append((both[:, :DIM] / np.maximum(length, 1)).astype(np.float32).tobytes())
        seen.append(both[:, DIM].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(units, pa.binary()), pa.array(seen, pa.binary())], ["first", "units", "seen"])


def word_vectors(docs: DataFrame, seed: int = 11) -> np.ndarray:
    """Normalised context vectors by bucket, weighted less for frequent words."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_context_sums(seed), "first long, sums binary")
    rows = sums.repartition(BUCKETS // ROWS, "first").mapInArrow(_add, "first long, units binary, seen binary").toArrow()  # BUCKETS / ROWS rows of fixed size
    out, seen = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS)
    for batch in rows.to_batches():
        for first, units, n in zip(*(batch.column(c) for c in ("first", "units", "seen")), strict=True):
            at = slice(first.as_py(), first.as_py() + ROWS)
            out[at] = np.frombuffer(units.as_buffer(), np.float32).reshape(ROWS, DIM)
            seen[at] = np.frombuffer(n.as_buffer(), np.int64)
    share = seen / max(seen.sum(), 1)
    out *= (1e-3 / (1e-3 + share)).astype(np.float32)[:, None]
    return out


N_FEATURES = 3 * DIM


def features(x: t.Texts, vectors: np.ndarray) -> np.ndarray:
    b, bound = _pieces(x)
    out = np.zeros((x.n, N_FEATURES), np.float32)
    n = np.diff(bound)
    full = np.flatnonzero(n)
    # gather vectors for a few documents at a time; a longer one in parts that are added up
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(bound[full + 1], bound[full[at]] + 16_000, side="right")))
        docs = full[at:to]
        sums = np.zeros((3, len(docs), DIM))
        low, high = int(bound[docs[0]]), int(bound[docs[-1] + 1])
        for a in range(low, high, 16_000):
            z = min(a + 16_000, high)
            v = vectors[b[a : min(z + 1, high)]]
            then = np.zeros((z - a, DIM), np.float32)
            then[: len(v) - 1] = v[: z - a][: len(v) - 1] * v[1:]
            last = bound[docs + 1] - 1 - a  # the last word of a document has none after it
            then[last[(last >= 0) & (last < z - a)]] = 0
            v = v[: z - a]
            inside = np.flatnonzero((bound[docs] < z) & (bound[docs + 1] > a))
            first = np.maximum(bound[docs[inside]] - a, 0)
            for i, part in enumerate((v, v * v, then)):
                sums[i, inside] += np.add.reduceat(part, first, axis=0)
        mean, square, then = sums / n[docs][:, None]
        out[docs] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), then], axis=1)
        at = to
    return out


class Network:
    """Two layers with standardised inputs and a temperature; fitted by Adam on full-precision numpy.

    Inputs may be of single precision; they are widened and standardised a few rows at a time, so the driver holds them once.
    """

    def __init__(self, hidden: int = 32, epochs: int = 40, seed: int = 5):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed
        self.constant: float | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.constant = None
        if len(y) < LEAST_LABELLED or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        random = np.random.default_rng(self.seed)
        y = y.astype(np.float64)
        self.mean = x.mean(0, dtype=np.float64)
        squares = sum(((x[i : i + 1024] - self.mean) ** 2).sum(0) for i in range(0, len(x), 1024))
        self.scale = np.sqrt(squares / len(x)) + 1e-6
        order = random.permutation(len(y))
        part = max(1, len(y) // 8)
        hold, calibrate, own = order[:part], order[part : 2 * part], order[2 * part :]  # for the epoch, for the temperature, for the weights
        held, held_y = self._norm(x[hold]), y[hold]
        p = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), random.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        best, kept = np.inf, p
        for epoch in range(self.epochs):
            rate = 3e-3 * (1 - epoch / self.epochs)
            for at in np.array_split(random.permutation(own), max(1, len(own) // 128)):
                part_x = self._norm(x[at])
                a = np.tanh(part_x @ p[0] + p[1])
                d = (self._sigmoid(a @ p[2] + p[3]) - y[at]) / len(at)
                back = np.outer(d, p[2]) * (1 - a * a)
                grad = [part_x.T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grad):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(np.tanh(held @ p[0] + p[1]) @ p[2] + p[3], held_y)
            if loss < best:
                best, kept = loss, [a.copy() for a in p]
        self.p = kept
        logits = self._logit(self._norm(x[calibrate]))
        self.temperature = min(np.exp(np.linspace(-2, 2, 161)), key=lambda z: self._loss(logits / z, y[calibrate]))
        return self

    def _norm(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        x /= self.scale
        return np.clip(x, -8, 8, out=x)

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return self._sigmoid(self._logit(self._norm(x)) / self.temperature)


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            for a, b, x in t.slices(batch.column("text"), t.SMALL):
                f = features(x, vectors)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, b - a), pa.array([r.tobytes() for r in f], pa.binary())], ["y", "f"])

    return run


def _scored(shared, network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            for a, b, x in t.slices(batch.column("text"), t.SMALL):
                rest = [batch.column(c).slice(a, b - a) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(network.score(features(x, vectors)))], [*batch.schema.names, "score"])

    return run


def _matrix(known: pa.Table) -> np.ndarray:
    """The column f as a matrix, copied row by row."""
    out = np.empty((len(known), N_FEATURES), np.float32)
    for i, f in enumerate(known.column("f")):
        out[i] = np.frombuffer(f.as_buffer(), np.float32)
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """docs with the column score (replaced if there): the probability that a document is good."""
    spark = docs.sparkSession
    docs = docs.drop("score")
    shared = spark.sparkContext.broadcast(word_vectors(docs))
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    # one text for each labelled document, however many rows repeat it
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("x")
    sample = sample.groupBy("doc_id").agg(least).select("x.text", "x.y")
    known = sample.mapInArrow(_featured(shared), "y double, f binary").toArrow()
    y, f = np.array(known.column("y").to_numpy()), _matrix(known)
    del known
    order = np.lexsort((y, *f.T[:4]))  # whatever order the rows came in
    f = f[order]
    network = Network().fit(f, (y[order] >= 0.5).astype(float))
    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(_scored(shared, network), f"{kinds}, score double")
