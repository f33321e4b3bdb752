"""Hard negatives against brute force in whole numbers: ties, windows, repeated rows, other dimensions, values that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, q string, dim string"


def brute(rows, every=5, scale=256):
    usable = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or sum((abs(x * scale) + 1) * (abs(x * scale) + 1) for x in v) >= 2.0**62:
            continue
        usable.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for i, label, a in usable:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, q)), j, other) for j, other, q in usable if j != i and len(q) == len(a)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 5 == 0, **sizes).collect())


@pytest.mark.parametrize("seed,dim,span,sizes", [
    (1, 4, 1.0, {"slab_rows": 40, "leaf_rows": 4, "block_anchors": 7}),
    (2, 2, 0.02, {"slab_rows": 64, "leaf_rows": 8, "block_anchors": 64}),  # few distinct values: ties everywhere
    (3, 16, 1.0, {}),
    (4, 3, 3e6, {"slab_rows": 50, "leaf_rows": 5}),  # products beyond 2**53
])
def test_equals_brute_force(spark, seed, dim, span, sizes):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-0.2 * span, span) for _ in range(dim)], rng.randrange(3)) for i in range(300)]
    got = mined(spark, rows, **sizes)
    assert got == brute(rows) and len(got) > 100


def test_one_hot_label_and_vector(spark):
    rows = [(i, [0.5, 0.25], 1) for i in range(150)] + [(i, [0.4, 0.2 + i / 10_000], 2) for i in range(150, 260)]
    assert mined(spark, rows, slab_rows=30, leaf_rows=4) == brute(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (5, [1.0, 0.4], 1), (6, [0.7, 0.3], 2), (6, [0.7, 0.3], 2), (7, None, 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (11, [1.0, None], 2),
            (12, [0.8, 0.4], None), (None, [0.8, 0.4], 2), (13, [0.9], 1), (15, [0.5], 1), (16, [0.45], 2), (20, [], 1), (21, [], 1), (22, [], 3), (25, [1e300, 1.0], 1),
            (30, [-1.0, -0.5], 3), (31, [0.6, 0.1], 3), (-5, [0.9, 0.9], 1), (33, [0.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(5, [1.0], 1)]) == []


def test_windows_have_no_gap():
    score = np.array([*range(-500, 500), 2**61 - 1, -(2**61)])
    low, high = hn.windows(score)
    for s, lo, hi in zip(score.tolist(), low.tolist(), high.tolist()):
        assert lo == -(-50 * s // 100) and hi == 95 * s // 100


def test_intervals_hold_all_scores():
    rng = np.random.default_rng(5)
    q = rng.integers(-200, 200, (64, 8))
    block = hn.Anchors(np.arange(10), np.zeros(10, int), rng.integers(-200, 200, (10, 8)))
    least, greatest = block.intervals(q.min(axis=0)[None], q.max(axis=0)[None])
    scores = block.scores(q, np.arange(10))
    assert (scores >= least).all() and (scores <= greatest).all()


def test_boxes_are_passed_over():
    """Far boxes are never opened: clustered rows, one search."""
    rng = np.random.default_rng(6)
    opened = []
    slabs = {}
    directory = []
    for c in range(20):
        q = rng.integers(0, 50, (64, 4)) + 1000 * c
        slabs[str(c)] = dict(ids=np.arange(64) + 64 * c, labels=np.ones(64, int), q=q, starts=np.array([0]), lo=q.min(axis=0)[None], hi=q.max(axis=0)[None], label_lo=np.array([1]), label_hi=np.array([1]))
        directory.append(([str(c)], np.array([1]), np.array([1]), q.min(axis=0)[None], q.max(axis=0)[None]))
    block = hn.Anchors(np.array([-1]), np.array([1]), np.array([[1, 1, 1, 1]]))
    far = np.array([np.iinfo(np.int64).max])
    search = hn.Searches(block, np.array([0]), -far, far, 5, True)
    hn.best_first(search, iter(directory), lambda u: opened.append(u) or slabs[u])
    every = np.concatenate([s["q"].sum(axis=1) for s in slabs.values()])
    assert sorted(search.score.tolist()) == sorted(every.tolist())[-5:] and set(opened) == {"19"}
