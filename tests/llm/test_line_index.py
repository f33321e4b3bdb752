"""Line dedup: perfect hash, shards, brute force."""

from collections import Counter

import numpy as np

from plumbline.llm import line_index as li

SCHEMA = "doc_id bigint, text string, n_lines string"


def brute(rows, least):
    keys = lambda t: [k.strip(b" \t\n\r\x0b\x0c").lower() for k in (t or "").encode().split(b"\n")]
    seen = Counter(k for _, t, _ in rows for k in set(keys(t)) if k)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x, k in zip(lines, keys(t)) if not k or seen[k] < least]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def run(spark, rows, least=3, **more):
    out = li.without_frequent_lines(spark.createDataFrame(rows, SCHEMA), least, **more).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out)


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "\n", " \t", "a\n\na", " Common \nonly", "COMMON", "common\r\nCommon", "common\x85", "é", "É", "é ", "É", "é", "z" * 200_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "common", None), (7, "common", None), (7, "common", None)]
    rows += [(100 + i, "\n".join(f"{' ' * int(k % 3)}Line {k}" for k in rng.integers(0, 300, 40)), "") for i in range(60)]
    assert run(spark, rows) == brute(rows, 3)
    assert run(spark, rows, keys_per_shard=7) == brute(rows, 3)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    keys = np.unique(keys)
    places = li.PerfectHash(keys).places(keys)
    assert sorted(places) == list(range(len(keys)))
    assert li.PerfectHash(keys[:0]).places(keys[:5]).tolist() == [-1] * 5


def test_shard_tells_strangers_apart():
    rng = np.random.default_rng(3)
    keys, prints = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)), None
    prints = rng.integers(0, 1 << 63, len(keys)).astype(np.uint64)
    counts = np.arange(len(keys)) + 10
    shard = li.Shard(np.append(keys, keys[0]), np.append(prints, np.uint64(5)), np.append(counts, 77))
    assert (shard.count(keys, prints) == counts).all()
    assert shard.count(keys[:1], np.array([5], np.uint64)).tolist() == [77]
    assert (shard.count(keys ^ np.uint64(1), prints ^ np.uint64(1)) == 0).all() and (shard.count(keys, prints ^ np.uint64(1)) == 0).all()


def test_small_cache(spark, monkeypatch):
    rows = [(i, f"same\nother {i % 5}\nown {i}", "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = li.build_index(li.frequent_lines(docs, 3), keys_per_shard=2)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in li.drop_lines(docs, index, 3, cache_bytes=1, batch_rows=4).collect())
    assert got == brute(rows, 3)
