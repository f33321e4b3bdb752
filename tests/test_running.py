"""Running medians, blocked correlations and reach, against NumPy and plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import lineage, running, selection


def test_running_median(spark):
    rng = random.Random(4)
    rows = [(m, p, rng.choice([None, 1.0, 2.5, rng.random() * 9])) for m, n in (("a", 300), ("b", 1), ("c", 17), ("d", 2)) for p in range(n)] + [("e", p, None) for p in range(3)]
    rng.shuffle(rows)
    out = running.running_median(spark.createDataFrame(rows, "metric string, period int, value double"), ["metric"], "period")
    assert out.columns == ["metric", "period", "value", "median"]
    got = {(r.metric, r.period): r.median for r in out.collect()}
    assert len(got) == len(rows)
    for m, p, _ in rows:
        past = [v for n, q, v in rows if n == m and q < p and v is not None]
        assert got[m, p] == (pytest.approx(np.median(past)) if past else None)
    assert [running.levels_of(n) for n in (0, 1, 16, 17, 256, 257, 1 << 20)] == [1, 1, 1, 2, 2, 3, 5]
    plan = out._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert "percentile" not in physical and physical.count("Exchange hashpartitioning") == 1


def test_blocked_correlations_of_5000_metrics(spark):
    base = F.when(F.col("m") % 50 == 0, F.col("m") - 1).otherwise(F.col("m"))
    cells = spark.range(5000 * 24).select((F.col("id") % 5000).alias("m"), F.floor(F.col("id") / 5000).alias("period"))
    value = (F.pmod(F.xxhash64(base, "period"), F.lit(1000)) * F.when(F.col("m") % 50 == 0, -2).otherwise(1)).cast("double")
    df = cells.select("period", F.format_string("m%05d", "m").alias("metric"), F.when(F.col("m") % 7 > 0, value).otherwise(F.lit(3.0)).alias("value"))
    got = {r.metric: r.keep for r in selection.correlation_filter(df).collect()}
    wide = df.toPandas().pivot(index="metric", columns="period", values="value").sort_index()
    with np.errstate(all="ignore"):
        high = np.triu(np.nan_to_num(np.abs(np.corrcoef(wide.to_numpy()))), k=1) > selection.CORRELATION
    assert got == dict(zip(wide.index, ~high.any(axis=0), strict=True)) and sum(not k for k in got.values()) > 50
    few = df.where("metric < 'm00050'").where("period <> 3 or metric <> 'm00002'")
    dense = {r.metric: r.keep for r in selection.correlation_filter(few, selection.metric_names(few)).collect()}
    assert {r.metric: r.keep for r in selection.wide_correlation_filter(few).collect()} == dense


def test_reach_with_cycles_and_a_hub(spark):
    rng = random.Random(3)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "hub"), ("s", "s"), ("x", "y")] + [("hub", f"n{i}") for i in range(400)]
    pairs += [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(150)] + [("x", "y")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = sorted({n for p in pairs for n in p})
    want = {}
    for start in nodes:
        depth, front = {start: 0}, [start]
        while front:
            front = [t for n in front for s, t in pairs if s == n and t not in depth and not depth.update({t: depth[n] + 1})]
        want |= {(start, n): d for n, d in depth.items()}
    got = lineage.impact(edges, spark.createDataFrame([(n,) for n in nodes], "start string")).collect()
    assert {(r.start, r.node): r.depth for r in got} == want and len(got) == len(want)
    sizes = {r.node: r.nodes for r in lineage.reach_sizes(edges).collect()}
    exact = {n: sum(s == n for s, _ in want) for n in nodes}
    assert set(sizes) == set(nodes) and all(abs(sizes[n] - exact[n]) <= 0.1 * exact[n] for n in nodes)
    with pytest.raises(RuntimeError):
        lineage.reach_sizes(edges, max_rounds=1)
