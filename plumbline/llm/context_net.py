"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated scores.

1. Every token (word or single sign) falls into one of ``buckets`` buckets and owns a sparse random index vector. The context
   vector of a bucket is the sum of the index vectors of its neighbours over all documents: whole-number sums, so the result
   does not depend on the order of tasks. A partition sends its sums once; they are added up block by block.
2. A document is the mean of its tokens' vectors and the mean of the products of adjacent ones (how alike neighbours are).
3. A network with one hidden layer is trained on a bounded sample of labelled documents (``most_labelled``, smallest hashes
   first); a part of the sample sets the temperature.
4. All documents are scored with the finished model, whose size depends on the parameters alone.

Only the text is read for a score. Defined cases: null and empty texts have zero features and still get a score; several
labels of one document are averaged; labels that are null or held out are not learnt; without any label of one of the two
classes the score is the smoothed share of label 1; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import release_memory, worker_cache, written

BUCKETS = 1 << 15
DIM = 64
NONZERO = 2
REACH = 2
SEED = 5
BLOCK = 256
MOST_LABELLED = 20_000
HIDDEN = 32
TOKEN = re.compile(r"\w+|[^\w\s]")
CHUNK = 1 << 16
GATHER = 1 << 19


class _Buckets(dict):
    """Bucket of each token, kept for the worker's life; emptied when it grows too large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[token] = out = zlib.crc32(token.encode()) % BUCKETS
        return out


_buckets = worker_cache(_Buckets())


def token_ids(text: str | None) -> np.ndarray:
    return np.fromiter(map(_buckets.__getitem__, TOKEN.findall(text)), np.int64) if text else np.empty(0, np.int64)


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (NONZERO, BUCKETS)), rng.choice(np.array([-1, 1]), (NONZERO, BUCKETS))


def _joined(texts, tokens: int = GATHER) -> Iterator[np.ndarray]:
    """Token ids of many texts, with gaps between texts that no pair reaches across."""
    gap, held, n = np.full(REACH, -1), [], 0
    for text in texts:
        ids = token_ids(text)
        held += [ids, gap]
        n += len(ids)
        if n >= tokens:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def context_sums(docs: DataFrame, seed: int = SEED) -> np.ndarray:
    """Sums of neighbours' index vectors, buckets x dimensions, over all documents."""
    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory(_buckets)
        places, signs = index_vectors(seed)
        sums = np.zeros(BUCKETS * DIM, np.int64)
        for batch in batches:
            for ids in _joined(t.as_py() for t in batch.column("text")):
                for off, at in itertools.product(range(1, REACH + 1), range(0, len(ids), GATHER)):
                    b = ids[at + off : at + off + GATHER]
                    a = ids[at : at + len(b)]
                    fine = (a >= 0) & (b >= 0)
                    for word, near in ((a[fine], b[fine]), (b[fine], a[fine])):
                        for place, sign in zip(places, signs, strict=True):
                            np.add.at(sums, word * DIM + place[near], sign[near])
        table = sums.reshape(-1, BLOCK * DIM).astype(np.int32)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_pydict({"block": pa.array(used, pa.int32()), "sums": pa.array([table[b].tobytes() for b in used], pa.binary())})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                got = np.frombuffer(sums.as_buffer(), sums_type[len(sums.as_buffer()) // (BLOCK * DIM)])
                total[block] = total.get(block, 0) + got.astype(np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    sums_type = {4: np.int32, 8: np.int64}
    layout = "block int, sums binary"
    parts = docs.select("text").mapInArrow(gather, layout)
    whole = parts.repartition(BUCKETS // BLOCK, "block").mapInArrow(add, layout)
    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), np.int64)
    for row in whole.toLocalIterator():  # buckets x dimensions in all, whatever the corpus
        out[row.block] = np.frombuffer(row.sums, np.int64)
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Damped sums without the common direction, scaled to length 1; buckets never seen stay zero."""
    v = np.sign(sums) * np.sqrt(np.abs(sums.astype(np.float64)))
    seen = v.any(axis=1)
    unit = lambda x: x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)
    v = unit(v)
    if seen.any():
        v[seen] -= v[seen].mean(axis=0)
    return (unit(v) * seen[:, None]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean of the token vectors, then mean of the products of adjacent ones."""
    ids = token_ids(text)
    out = np.zeros(2 * DIM)
    for at in range(0, len(ids), CHUNK):
        e = vectors[ids[at : at + CHUNK + 1]]
        out[:DIM] += e[:CHUNK].sum(axis=0)
        if len(e) > 1:
            out[DIM:] += np.einsum("ij,ij->j", e[:-1], e[1:])
    if len(ids):
        out[:DIM] /= len(ids)
        out[DIM:] /= max(1, len(ids) - 1)
    return out


@dataclass
class Network:
    """tanh hidden layer and a logistic output over standardised features."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED, hidden: int = HIDDEN, epochs: int = 60, batch: int = 128, rate: float = 3e-3,
          decay: float = 1e-4) -> Network:
    """Adam on cross-entropy; every fifth row is left out of it and sets the temperature."""
    spread = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(2 * DIM)
    mean = x.mean(axis=0) if len(x) else np.zeros(2 * DIM)
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    start = lambda n: np.zeros(n)
    net = Network(mean, spread, rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), start(hidden), start(hidden), float(np.log(share / (1 - share))))
    if len(y) < 10 or not 0 < y.mean() < 1:
        return net
    z = (x - mean) / spread
    calibrate = np.arange(len(y)) % 5 == 0
    zf, yf = z[~calibrate], y[~calibrate]
    state = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    n = 0
    for epoch in range(epochs):
        order = rng.permutation(len(yf))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            h = np.tanh(zf[rows] @ state[0] + state[1])
            out = 1 / (1 + np.exp(-np.clip(h @ state[2] + state[3][0], -50, 50)))
            d = (out - yf[rows]) / len(rows)
            dh = np.outer(d, state[2]) * (1 - h**2)
            slopes = [zf[rows].T @ dh + decay * state[0], dh.sum(axis=0), h.T @ d + decay * state[2], np.array([d.sum()])]
            n += 1
            for p, g, (m, v) in zip(state, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    net = Network(mean, spread, state[0], state[1], state[2], float(state[3][0]))
    logits, truth = net.logits(x[calibrate]), y[calibrate]
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


def features(docs: DataFrame, vectors, keep: list[str]) -> DataFrame:
    """``keep`` and the pooled features; ``vectors`` is a broadcast variable."""
    def pool(batches: Iterator) -> Iterator:
        release_memory(_buckets)
        for f in batches:
            f["features"] = [pooled(t, vectors.value) for t in f.pop("text")]
            yield f

    return docs.select(*keep, "text").mapInPandas(pool, docs.select(*keep, F.array(F.lit(0.0)).alias("features")).schema)


def held_out(doc_id):
    """The rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED, seed: int = SEED):
    """Word vectors (broadcast) and the trained network."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(context_sums(docs, seed)))
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.avg(label).alias("y")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labelled)
    sample = written(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most most_labelled rows of two numbers
    rows = features(chosen, vectors, ["doc_id", "y"]).groupBy("doc_id").agg(F.first("y").alias("y"), F.min("features").alias("features"))
    got = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labelled).collect()
    x = np.array([r.features for r in got]) if got else np.zeros((0, 2 * DIM))
    return vectors, train(x, np.array([r.y for r in got], float), seed)


def score(docs: DataFrame, vectors, network: Network, threshold: float = 0.7) -> DataFrame:
    """The documents with score and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory(_buckets)
        for batch in batches:
            x = np.array([pooled(t.as_py(), vectors.value) for t in batch.column("text")]).reshape(-1, 2 * DIM)
            scores = network.scores(x)
            cols = [batch.column(c) for c in names] + [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "predicted"])

    docs = docs.select(*names)
    return docs.mapInArrow(run, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
