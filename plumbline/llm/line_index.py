"""Line dedup: lines found in many documents are dropped, looked up in a sharded minimal perfect hash.

1. Lines are counted by the two halves of a 128-bit hash of their key, once per document, with map-side sums.
2. The hashes of lines in at least ``least_documents`` documents are dealt over shards of about ``keys_per_shard`` keys by
   their first hash. For each shard a task builds a minimal perfect hash (levels of bit arrays: a key that is alone at its
   place stays, the others go to the next level) and two arrays in its order: fingerprints (second hash) and counts. Each
   shard is one file in the shared folder.
3. Documents probe the shards in large batches, one shard after the other; a worker keeps decoded shards up to
   ``cache_bytes``. No line is shuffled for this, and the whole index never lies on the driver.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Defined cases: every row is a document; null and
empty texts have one empty line, which is never dropped; a document that loses all lines keeps an empty text; an empty
table gives an empty index. Other columns are passed on unless they are named like the three new ones.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from plumbline.llm.common import open_folder, pieces_of, release_memory, shared_folder, worker_cache, written

LEAST_DOCUMENTS = 10
KEYS_PER_SHARD = 65536
CACHE_BYTES = 64 << 20


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A fresh hash of 64-bit keys for each level."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about three bits a key."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size, before = len(keys), 0
        while len(keys):
            m = max(64, int(room * len(keys)))
            at = _mix(keys, len(self.levels)) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            bits = np.zeros(-(-m // 64) * 64, np.uint8)
            bits[:m] = alone
            packed = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = before + np.concatenate(([0], np.cumsum(np.bitwise_count(packed))[:-1])).astype(np.int64)
            self.levels.append((m, packed, ranks.astype(np.uint32)))
            before += int(alone.sum())
            keys = keys[~alone[at.astype(np.int64)]]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 for keys that surely were not there. Others that were not there get any place."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for n, (m, packed, ranks) in enumerate(self.levels):
            at = _mix(keys[left], n) % np.uint64(m)
            block, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            word = packed[block]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = ranks[block[hit]] + below[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class Shard:
    """Fingerprints and counts in the order of the perfect hash."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        # two lines may share the first hash: the rest of such a pair goes to a short list
        order = np.lexsort((prints, keys))
        keys, prints, counts = keys[order], prints[order], counts[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        self.more = {(int(k), int(p)): int(c) for k, p, c in zip(keys[~first], prints[~first], counts[~first], strict=True)}
        keys, prints, counts = keys[first], prints[first], counts[first]
        self.hash = PerfectHash(keys)
        places = self.hash.places(keys)
        self.prints, self.counts = np.empty(len(keys), np.uint64), np.empty(len(keys), np.int64)
        self.prints[places], self.counts[places] = prints, counts

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Documents of each line, 0 if it is not in the index."""
        at = self.hash.places(keys)
        out = np.zeros(len(keys), np.int64)
        found = at >= 0
        found[found] = self.prints[at[found]] == prints[found]
        out[found] = self.counts[at[found]]
        for (k, p), c in self.more.items():
            out[(keys == np.uint64(k)) & (prints == np.uint64(p))] = c
        return out


def hash_lines(text: str | None) -> np.ndarray:
    """Two 64-bit hashes per line, both 0 for lines without a key. bytes.strip and bytes.lower know ASCII alone, as keys do."""
    lines = (text or "").encode().split(b"\n")
    keys = [line.strip().lower() for line in lines]
    both = b"".join(xxh3_128_digest(k) if k else bytes(16) for k in keys)
    return np.frombuffer(both, np.uint64).reshape(-1, 2)


def frequent_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """h, p, n: hashes of the lines that at least so many documents hold."""
    def hashes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        for batch in pieces_of(batches, 512):
            each = [np.unique(hash_lines(t.as_py()), axis=0) for t in batch.column("text")]
            both = np.concatenate(each) if each else np.empty((0, 2), np.uint64)
            both = both[both.any(axis=1)].view(np.int64)
            yield pa.RecordBatch.from_pydict({"h": pa.array(both[:, 0]), "p": pa.array(both[:, 1])})

    each = docs.select("text").mapInArrow(hashes, "h bigint, p bigint")
    return each.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_documents)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.int64) % shards


def build_index(lines: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[list[str], int]:
    """URIs of the shard files and the number of shards; ``shard_of`` tells a line's shard."""
    lines = written(lines)
    shards = max(1, -(-lines.count() // keys_per_shard))
    folder = shared_folder(lines.sparkSession)

    def build(key, part):
        import pandas as pd

        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{key[0]:08d}-{uuid.uuid4().hex}"  # a task that runs again writes another file
        shard = Shard(*(part[c].to_numpy().astype(np.int64).view(t) for c, t in (("h", np.uint64), ("p", np.uint64), ("n", np.int64))))
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(shard, protocol=5))
        return pd.DataFrame({"shard": [key[0]], "name": [name]})

    dealt = lines.withColumn("shard", F.shiftrightunsigned("h", 33) % shards)
    names = written(dealt.groupBy("shard").applyInPandas(build, "shard bigint, name string"))
    return [(r.shard, f"{folder}/{r.name}") for r in names.orderBy("shard").collect()], shards


_decoded: dict[str, Shard] = worker_cache({})


def _load(uri: str, cache_bytes: int) -> Shard:
    """A shard from its file; as many as fit into ``cache_bytes`` stay decoded in the worker."""
    if uri in _decoded:
        return _decoded[uri]
    fs, path = open_folder(uri)
    with fs.open_input_stream(path) as stream:
        shard = pickle.loads(stream.read())
    if sum(24 * s.hash.size for s in _decoded.values()) + 24 * shard.hash.size > cache_bytes:
        _decoded.clear()
    _decoded[uri] = shard
    return shard


def drop_lines(docs: DataFrame, index: tuple[list[str], int], least_documents: int = LEAST_DOCUMENTS, cache_bytes: int = CACHE_BYTES,
               batch_rows: int = 4096) -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text."""
    files, shards = index
    taken = {"n_lines", "n_dropped", "kept_text"}
    names = [c for c in docs.columns if c not in taken]
    docs = docs.select(*names)

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory(_decoded)
        for batch in pieces_of(batches, batch_rows):
            each = [hash_lines(t.as_py()) for t in batch.column("text")]
            both = np.concatenate(each) if each else np.empty((0, 2), np.uint64)
            gone, asked = np.zeros(len(both), bool), np.flatnonzero(both.any(axis=1))
            own = shard_of(both[asked, 0], shards)
            order = np.argsort(own, kind="stable")
            asked, own = asked[order], own[order]
            for shard, uri in files:
                lo, hi = np.searchsorted(own, [shard, shard + 1])
                if lo < hi:
                    at = asked[lo:hi]
                    gone[at] = _load(uri, cache_bytes).count(both[at, 0], both[at, 1]) >= least_documents
            ends = np.cumsum([len(x) for x in each])
            n_lines, n_dropped, kept, at = [], [], [], 0
            for text, end in zip(batch.column("text"), ends, strict=True):
                mask, at = gone[at:end], int(end)
                drops = int(mask.sum())
                text = text.as_py() or ""
                n_lines.append(len(mask))
                n_dropped.append(drops)
                kept.append(text if not drops else "\n".join(x for x, g in zip(text.split("\n"), mask, strict=True) if not g))
            cols = [batch.column(c) for c in names] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_lines", "n_dropped", "kept_text"])

    schema = docs.withColumns({"n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint"), "kept_text": F.lit("")}).schema
    return docs.mapInArrow(probe, schema)


def without_frequent_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Counts, builds and probes."""
    index = build_index(frequent_lines(docs, least_documents), keys_per_shard)
    return drop_lines(docs, index, least_documents)
