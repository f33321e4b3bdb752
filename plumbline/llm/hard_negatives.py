"""Hard negatives: for anchors and their positives, the best rows of other labels whose score lies in a window below the positive's.

Components become ``floor(scale * x)``, scores are integer inner products. Rows are packed into an R-tree and every search
descends it best first:

1. *Packing.* Rows are dealt by ranges of (dimension, label, first component, id), so that equal components and hot labels spread
   over many slabs. Inside a slab of about ``slab_rows`` rows the leaves are sort-tile-recursive tiles: slices by label and the
   component that spreads most, cut into runs of ``leaf_rows`` by the next one. A slab is one file in the shared folder; its
   bounding box is a row of the directory table, which is the upper level of the tree.
2. *Intervals.* For an anchor a and a box, sum(max(a*lo, a*hi)) and sum(min(a*lo, a*hi)) bound all inner products in the box.
3. *Search.* A task takes a block of anchors and keeps one queue of boxes, the box with the highest possible score first. A box is
   passed over if for every search of the block its interval misses the score window, lies strictly below the k-th score
   found, or its labels rule it out; ties with the k-th are followed, since the smaller id wins. Slab files are opened only when
   their box comes up. Positives are searched first (own label, no window); they give the windows of the second search.

A task holds one block of anchors, their best rows and a bounded cache of slabs. The directory has one row per slab.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors whose squared
length after scaling reaches 2**62 (their scores need not fit a long). Vectors meet only vectors of their own dimension; the
empty vector scores 0. Rows that share the anchor's id are no candidates of it; otherwise repeated rows are rows of their own, a
repeated anchor is searched as often as it comes. Equal scores are ordered by id. A positive with a negative score has an empty
window. An empty table gives no rows. Other columns are ignored. There are no texts.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import open_folder, shared_folder, worker_cache, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # percent of the positive's score
LEAF_ROWS = 256
SLAB_ROWS = 8192
BLOCK_ANCHORS = 1024
CACHE_BYTES = 32 << 20
DIRECTORY_BATCH = 1024


def usable(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (scaled components), dim of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * scale) + 1, F.lit(2)))
    rows = rows.filter(length < float(1 << 62))
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("q"), F.size("embedding").alias("dim"))


def tiles(q: np.ndarray, labels: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and first place of each leaf: slices by label and widest component, runs by the second widest."""
    n = len(labels)
    leaves = -(-n // leaf_rows)
    wide = np.argsort(-q.var(axis=0), kind="stable")[:2] if q.shape[1] else np.empty(0, int)
    first = q[:, wide[0]] if len(wide) else np.zeros(n)
    order = np.lexsort((first, labels))
    if len(wide) > 1:
        step = leaf_rows * max(1, int(np.ceil(np.sqrt(leaves))))
        for at in range(0, n, step):
            own = order[at : at + step]
            order[at : at + step] = own[np.lexsort((q[own, wide[1]], labels[own]))]
    return order, np.arange(0, n, leaf_rows)


def _boxes(q: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(q, starts, axis=0), np.maximum.reduceat(q, starts, axis=0)


def pack(rows: DataFrame, slab_rows: int = SLAB_ROWS, leaf_rows: int = LEAF_ROWS) -> str:
    """Writes the slabs and returns the URI of the directory table: path, dim, label_lo, label_hi, lo, hi."""
    folder = shared_folder(rows.sparkSession)
    slabs = max(1, -(-rows.count() // slab_rows))

    def slab(fs, base, ids, labels, q):
        order, starts = tiles(q, labels, leaf_rows)
        ids, labels, q = ids[order], labels[order], q[order]
        lo, hi = _boxes(q, starts)
        label_lo, label_hi = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        name, data = uuid.uuid4().hex, io.BytesIO()  # a task that runs again writes another file
        np.savez(data, ids=ids, labels=labels, q=q, starts=starts, lo=lo, hi=hi, label_lo=label_lo, label_hi=label_hi)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(data.getbuffer())
        return (f"{folder}/{name}", q.shape[1], int(labels.min()), int(labels.max()), lo.min(axis=0).tolist(), hi.max(axis=0).tolist())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        names = ["path", "dim", "label_lo", "label_hi", "lo", "hi"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

        def out(held):
            made = []
            dims = np.concatenate([d for *_, d in held])
            for dim in np.unique(dims):
                ids, labels, flat = [], [], []
                for i, l, q, d in held:
                    own = d == dim
                    ids.append(i[own])
                    labels.append(l[own])
                    flat.append(q[np.repeat(own, d)])
                made.append(slab(fs, base, np.concatenate(ids), np.concatenate(labels), np.concatenate(flat).reshape(len(np.concatenate(ids)), dim)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        held, n = [], 0
        for batch in batches:
            held.append(_arrays(batch))
            n += batch.num_rows
            if n >= 2 * slab_rows:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    dealt = rows.repartitionByRange(slabs, "dim", "label", F.get("q", F.lit(0)), "vec_id")
    dealt.mapInArrow(run, "path string, dim int, label_lo bigint, label_hi bigint, lo array<int>, hi array<int>").write.parquet(f"{folder}/directory")
    return f"{folder}/directory"


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, all components one after the other, dimensions."""
    q = batch.column("q")
    flat = q.flatten().to_numpy(zero_copy_only=False)
    return (batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False),
            flat.astype(np.int16 if len(flat) and max(flat.max(), -flat.min()) < 1 << 15 else np.int32), batch.column("dim").to_numpy(zero_copy_only=False))


_slabs: dict[str, dict[str, np.ndarray]] = worker_cache({})


def _load(uri: str, cache_bytes: int = CACHE_BYTES) -> dict[str, np.ndarray]:
    """Arrays of a slab; as many as fit into ``cache_bytes`` stay in the worker."""
    if uri not in _slabs:
        fs, path = open_folder(uri)
        with fs.open_input_stream(path, compression=None) as stream, np.load(io.BytesIO(stream.read())) as found:
            slab = {k: found[k] for k in found.files}
        if sum(s["q"].nbytes for s in _slabs.values()) + slab["q"].nbytes > cache_bytes:
            _slabs.clear()
        _slabs[uri] = slab
    return _slabs[uri]


class Anchors:
    """Ids, labels and vectors of a block, and bounds of their inner products with boxes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, q.astype(np.int64)
        real = q.astype(np.float64)
        self.real, self.above, self.below = real, np.maximum(real, 0).T, np.minimum(real, 0).T
        self.largest = float(np.abs(real).max(initial=0))

    def exact(self, most: float) -> bool:
        """Whether float products with components up to ``most`` have no rounding."""
        return self.whole.shape[1] * self.largest * most < 2.0**53

    def intervals(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score: boxes x anchors."""
        lo, hi = lo.astype(np.float64), hi.astype(np.float64)
        greatest, least = hi @ self.above + lo @ self.below, lo @ self.above + hi @ self.below
        far = np.maximum(np.abs(lo), np.abs(hi))
        if not self.exact(float(far.max(initial=0))):
            slack = (far @ (self.above - self.below)) * 2.0**-40 + 1
            greatest, least = greatest + slack, least - slack
        return least, greatest

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows x anchors ``at``, exact."""
        if self.exact(float(np.abs(q).max(initial=0))):
            return (q.astype(np.float64) @ self.real[at].T).astype(np.int64)
        return q.astype(np.int64) @ self.whole[at].T


class Searches:
    """For each search an anchor, a score window and its best ``k`` rows so far; ``same`` asks for the anchor's label, else for others."""

    def __init__(self, anchors: Anchors, at: np.ndarray, lowest: np.ndarray, highest: np.ndarray, k: int, same: bool):
        self.anchors, self.at, self.floor, self.top, self.k, self.same = anchors, at, lowest.copy(), highest, k, same
        self.own, self.score, self.vec, self.rank = (np.empty(0, np.int64) for _ in range(4))
        self.label = anchors.labels[at]
        self.begins = np.searchsorted(at, np.arange(len(anchors.ids) + 1))  # ``at`` ascends

    def alive(self, least, greatest, label_lo, label_hi) -> np.ndarray:
        """Boxes x searches: whether a box may hold a row that is wanted."""
        lo, hi = label_lo[:, None], label_hi[:, None]
        labels = (lo <= self.label) & (self.label <= hi) if self.same else (lo != hi) | (lo != self.label)
        return labels & (greatest[:, self.at] >= self.floor) & (least[:, self.at] <= self.top)

    def take(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, live: np.ndarray) -> None:
        """Scores a leaf's rows for the anchors of the live searches and keeps the best."""
        a = np.unique(self.at[live])
        scores = self.anchors.scores(q, a)
        counts = np.diff(self.begins)[a]
        floor, top = np.minimum.reduceat(self.floor, self.begins[a]), np.maximum.reduceat(self.top, self.begins[a])
        # reduceat runs to the next anchor of the list, which at worst widens the window
        row, col = np.nonzero((scores >= floor) & (scores <= top) & ((labels[:, None] == self.anchors.labels[a]) == self.same) & (ids[:, None] != self.anchors.ids[a]))
        if not len(row):
            return
        found, times = scores[row, col], counts[col]
        search = np.repeat(self.begins[a][col], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found, vec = np.repeat(found, times), np.repeat(ids[row], times)
        good = (found >= self.floor[search]) & (found <= self.top[search])
        own, score, vec = (np.concatenate(x) for x in ((self.own, search[good]), (self.score, found[good]), (self.vec, vec[good])))
        order = np.lexsort((vec, -score, own))
        own, score, vec = own[order], score[order], vec[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        best = rank < self.k
        self.own, self.score, self.vec, self.rank = own[best], score[best], vec[best], rank[best]
        full = self.rank == self.k - 1
        self.floor[self.own[full]] = self.score[full]


def best_first(searches: Searches, directory: Iterator, load=_load) -> None:
    """Descends from the directory's boxes to leaves, the box with the highest possible score first."""
    if not len(searches.at):
        return
    anchors, queue, count = searches.anchors, [], 0

    def push(lo, hi, label_lo, label_hi, name):
        nonlocal count
        least, greatest = anchors.intervals(lo, hi)
        live = searches.alive(least, greatest, label_lo, label_hi)
        reach = np.where(live, np.minimum(greatest[:, searches.at], searches.top), -np.inf).max(axis=1)
        for i in np.flatnonzero(live.any(axis=1)):
            count += 1
            heapq.heappush(queue, (-reach[i], count, *name(i), lo[i], hi[i], label_lo[i], label_hi[i]))

    for paths, label_lo, label_hi, lo, hi in directory:
        push(lo, hi, label_lo, label_hi, lambda i, paths=paths: (paths[i], None))
    while queue:
        _, _, uri, leaf, lo, hi, label_lo, label_hi = heapq.heappop(queue)
        least, greatest = anchors.intervals(lo[None], hi[None])
        live = searches.alive(least, greatest, np.array([label_lo]), np.array([label_hi]))[0]
        if not live.any():
            continue
        slab = load(uri)
        if leaf is None:
            push(slab["lo"], slab["hi"], slab["label_lo"], slab["label_hi"], lambda i, uri=uri: (uri, i))
            continue
        start = slab["starts"][leaf]
        end = slab["starts"][leaf + 1] if leaf + 1 < len(slab["starts"]) else len(slab["ids"])
        searches.take(slab["ids"][start:end], slab["labels"][start:end], slab["q"][start:end], live)


def windows(score: np.ndarray, lowest: int = LOWEST, highest: int = HIGHEST) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole number s with lowest * score <= 100 * s <= highest * score, without overflow."""
    hundreds, rest = score // 100, score % 100
    return hundreds * lowest + -(-rest * lowest // 100), hundreds * highest + rest * highest // 100


def _read_directory(uri: str, dim: int, rows: int = DIRECTORY_BATCH) -> Iterator:
    import pyarrow.dataset as ds

    fs, path = open_folder(uri)
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(filter=ds.field("dim") == dim, batch_size=rows):
        if batch.num_rows:
            boxes = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim) for c in ("lo", "hi"))
            yield batch.column("path").to_pylist(), batch.column("label_lo").to_numpy(), batch.column("label_hi").to_numpy(), *boxes


def mine(table: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST,
         highest: int = HIGHEST, slab_rows: int = SLAB_ROWS, leaf_rows: int = LEAF_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. ``is_anchor`` is a condition on vec_id."""
    rows = written(usable(table, scale))
    directory = pack(rows, slab_rows, leaf_rows)
    anchors = rows.filter(is_anchor)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = anchors.count()
    blocks = max(1, min(-(-n // 64), max(2 * cores, -(-n // block_anchors))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, block_anchors):
                ids, labels, flat, dims = _arrays(batch.slice(at, block_anchors))
                for dim in np.unique(dims):
                    own = dims == dim
                    block = Anchors(ids[own], labels[own], flat[np.repeat(own, dims)].reshape(own.sum(), dim))
                    a = np.arange(own.sum())
                    far = np.full(len(a), np.iinfo(np.int64).max)
                    first = Searches(block, a, -far, far, positives, True)
                    best_first(first, _read_directory(directory, dim))
                    low, high = windows(first.score, lowest, highest)
                    open_ = low <= high
                    anchor, positive, score = first.own[open_], first.vec[open_], first.score[open_]
                    second = Searches(block, anchor, low[open_], high[open_], negatives, False)
                    best_first(second, _read_directory(directory, dim))
                    yield pa.RecordBatch.from_pydict({
                        "anchor_id": pa.array(block.ids[anchor[second.own]], pa.int64()), "positive_id": pa.array(positive[second.own], pa.int64()),
                        "rank": pa.array(second.rank + 1, pa.int32()), "negative_id": pa.array(second.vec, pa.int64()),
                        "positive_score": pa.array(score[second.own], pa.int64()), "negative_score": pa.array(second.score, pa.int64())})

    layout = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    dealt = anchors.repartitionByRange(blocks, "dim", "label", F.get("q", F.lit(0)), "vec_id")
    return written(dealt.mapInArrow(run, layout))
