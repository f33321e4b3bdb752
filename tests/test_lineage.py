"""Reachable pairs and sketched sizes: what they leave on disk, and results when the work is cut into parts."""

import os
import random
from urllib.parse import urlparse

import pytest

from plumbline.operators import lineage
from plumbline.sources import checkpoint


def searched(pairs, starts):
    depths = {}
    for start in starts:
        seen, front = {start: 0}, [start]
        while front:
            front = [t for n in front if n is not None for s, t in pairs if s == n and t not in seen and not seen.update({t: seen[n] + 1})]
        depths |= {(start, n): d for n, d in seen.items()}
    return depths


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def tables(spark):
    checkpoint.prepare(spark)
    at = urlparse(spark.sparkContext.getCheckpointDir()).path
    return set(os.listdir(at))


def graph():
    rng = random.Random(7)
    pairs = [("hub", f"n{i}") for i in range(60)] + [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n3", "hub"), ("n4", None), (None, "n5"), ("t", "t"), ("n8", "n2")]
    return pairs + [(f"n{rng.randrange(60)}", f"m{rng.randrange(30)}") for _ in range(80)] + [("hub", "n1")] * 3


def test_pairs_lie_in_arrays_and_nothing_else_is_left(spark):
    edges = spark.createDataFrame([("a", f"b{i}") for i in range(50)] + [("b1", "c"), ("c", "d")], "source string, target string")
    before, files = tables(spark), shuffle_files(spark)
    out = lineage.impact(edges, spark.createDataFrame([("a",)], "start string"))
    assert shuffle_files(spark) <= files
    assert {os.path.basename(os.path.dirname(f)) for f in out.inputFiles()} == tables(spark) - before
    assert spark.read.parquet(*out.inputFiles()).count() == 4 and out.count() == 53


@pytest.mark.parametrize("row", [4, 1 << 16])
def test_pairs_in_parts_and_slices(spark, monkeypatch, row):
    for name, value in {"ROW": row, "PART": 8, "FOLDERS": 5}.items():
        monkeypatch.setattr(lineage, name, value)
    pairs, starts = graph(), ["hub", "n0", "n3", "m1", "t", "lone", None, "hub"] + [f"n{i}" for i in range(20, 40)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    got = lineage.impact(edges, spark.createDataFrame([(s,) for s in starts], "start string")).collect()
    want = searched(pairs, starts)
    assert {(r.start, r.node): r.depth for r in got} == want and len(got) == len(want)


def test_sketches_in_parts(spark, monkeypatch):
    for name, value in {"ROW": 16, "SKETCHED": 30}.items():
        monkeypatch.setattr(lineage, name, value)
    pairs = graph()
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = sorted({n for p in pairs for n in p if n is not None})
    want = searched([p for p in pairs if None not in p], nodes)
    before, files = tables(spark), shuffle_files(spark)
    out = lineage.reach_sizes(edges, precision=14)
    got = {r.node: (r.nodes, r.rounds) for r in out.collect()}
    exact = {n: sum(s == n for s, _ in want) for n in nodes}
    assert set(got) == set(nodes) and all(abs(got[n][0] - exact[n]) <= 0.05 * exact[n] for n in nodes)
    assert all(got[n][1] == max(d for (s, _), d in want.items() if s == n) for n in nodes)
    assert {os.path.basename(os.path.dirname(f)) for f in out.inputFiles()} == tables(spark) - before
    assert not any(f.endswith(".data") for f in shuffle_files(spark) - files)
