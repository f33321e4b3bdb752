"""Nearest neighbours: brute force, ties, recall, unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import rotated_codes as rc

SCHEMA = "vec_id bigint, embedding array<float>, length string"


def brute(rows, k, every):
    fine = [(i, np.array(v, np.float32)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, (i, q) in enumerate(fine):
        if i % every:
            continue
        scores = [(-float(rc.exact(v[None], q)[0]), j) for m, (j, v) in enumerate(fine) if m != n and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=3, **more):
    out = rc.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, k, **more)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(12).astype(np.float32)], "clash") for i in range(200)]
    rows += [(i, rows[3][1], None) for i in range(200, 215)]  # ties
    rows += [(300, None, ""), (303, [], ""), (306, [0.0] * 12, ""), (309, [None] + [1.0] * 11, ""), (312, [float("nan")] * 12, ""), (315, [float("inf")] * 12, ""),
             (None, [1.0] * 12, ""), (318, [1.0, 2.0], ""), (319, [2.0, 1.0], ""), (321, [1e-30] * 12, ""), (324, [1e18] * 12, "")]
    assert run(spark, rows) == brute(rows, 5, 3)
    assert run(spark, rows, query_block=10, row_block=30) == brute(rows, 5, 3)


def test_repeated_rows_and_few_candidates(spark):
    rows = [(3, [1.0, 0.0], ""), (3, [1.0, 0.0], ""), (4, [0.0, 1.0], "")]
    got = run(spark, rows)
    assert got == [(3, 1, 3, 1.0), (3, 1, 3, 1.0), (3, 2, 4, 0.0), (3, 2, 4, 0.0)]


def test_double_embeddings_keep_their_precision(spark):
    rows = [(3, [1.0, 0.0]), (4, [0.5, 0.1]), (5, [0.5 + 1e-12, 0.1]), (7, [1e39, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in rc.nearest(table, F.col("vec_id") == 3, 3).orderBy("rank").collect()]
    assert got == [(7, 1e39), (5, 0.5 + 1e-12), (4, 0.5)]


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(6, [1.0], "")]) == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    turn = rc.rotation(64)
    codes, lengths, own = rc.encode(v, turn)
    assert codes.shape == (3000, 8)
    got, error = rc.estimate(codes, own, v[:50], turn)
    truth = (v[:50] @ v.T) / lengths[:50, None] / lengths[None]
    off = np.abs(got - truth) / error
    off[np.arange(50), np.arange(50)] = 0
    assert (off > rc.SIGMAS).mean() < 1e-4 and 0.5 < off.mean() < 1.1


def test_few_candidates_are_scored_exactly(monkeypatch):
    import pandas as pd

    v = np.random.default_rng(5).standard_normal((3000, 64))
    rows = pd.DataFrame({"row": range(3000), "vec_id": range(3000), "vector": list(v), "dim": 64})
    rows = next(rc.coder(rc.SEED)(iter([rows])))
    scored, exact = [], rc.exact
    monkeypatch.setattr(rc, "exact", lambda vectors, q: scored.append(len(vectors)) or exact(vectors, q))
    found = list(rc.search_block(rows, rows.iloc[:50], 20, rc.SIGMAS))
    assert sum(scored) < 50 * 100
    truth = v[:50] @ v.T
    truth[np.arange(50), np.arange(50)] = -np.inf
    assert [f[2] for f in found] == np.argsort(-truth, axis=1)[:, :20].reshape(-1).tolist()
