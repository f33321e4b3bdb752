"""Quality classifier: whole-number sums, held-out accuracy, defined cases."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import context_net as cn

FOLDER = "/root/testdata/sf0.01"


def test_context_sums_by_brute_force(spark):
    texts = ["a b c a", None, "", "b b! c", "a " * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    places, signs = cn.index_vectors()
    want = np.zeros((cn.BUCKETS, cn.DIM), np.int64)
    for t in texts:
        ids = [zlib.crc32(x.encode()) % cn.BUCKETS for x in cn.TOKEN.findall(t or "")]
        for i, j in itertools.product(range(len(ids)), (-2, -1, 1, 2)):
            if 0 <= i + j < len(ids):
                for p, s in zip(places, signs):
                    want[ids[i], p[ids[i + j]]] += s[ids[i + j]]
    assert (cn.context_sums(docs) == want).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    vectors, network = cn.fit(docs, labels)
    out = cn.score(docs, vectors, network)
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1").count() == 0
    test = out.withColumn("held_out", cn.held_out(F.col("doc_id"))).join(labels, "doc_id").filter("held_out").collect()
    assert len(test) > 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in test)
    right = [r.predicted == r.quality for r in test]
    assert sum(right) / len(right) > 0.95
    assert sum(r.predicted for r in test if r.quality == 1) / sum(r.quality for r in test) > 0.97
    assert 0.25 <= network.temperature <= 8
    again = {r.doc_id: r.score for r in cn.score(docs.repartition(3), *cn.fit(docs.repartition(5), labels.repartition(2))).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in test) < 1e-6


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "z " * 100_000)], "doc_id bigint, text string")
    for labels in ([], [(1, 1)], [(1, 0), (1, 1), (None, 1), (2, None)]):
        table = spark.createDataFrame(labels, "doc_id bigint, quality int")
        out = cn.score(docs, *cn.fit(docs, table)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    empty = docs.limit(0)
    assert cn.score(empty, *cn.fit(empty, spark.createDataFrame([], "doc_id bigint, quality int"))).count() == 0


def test_training_separates_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 2 * cn.DIM))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (rng.random(3000) < p).astype(float)
    net = cn.train(x[:2500], y[:2500])
    s = net.scores(x[2500:])
    assert abs(s.mean() - y[2500:].mean()) < 0.08
