"""Stored states: merging equals building, errors stay within bounds, histories hold the days before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import sketch_state as ss

Q = {"q10": 0.1, "median": 0.5, "q99": 0.99}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n), "D"), "x": 1e9 + rng.lognormal(0, 2, n), "y": rng.integers(0, 50, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    pdf.loc[pdf.ts == pd.Timestamp("2024-01-05"), "y"] = np.nan  # a day without a value
    return spark.createDataFrame(pdf), pdf


def test_merging_equals_building(spark, table):
    df, pdf = table
    got = {r.column: r for r in ss.finished_states(ss.merged_states(ss.period_states(df, "ts", ["x", "y"]), ["column"]), ["column"], Q).collect()}
    for c in "xy":
        v = pdf[c].dropna()
        r = got[c]
        assert (r["count"], r.missing_count, r["min"], r["max"]) == (len(v), len(pdf) - len(v), v.min(), v.max())
        assert r.mean == pytest.approx(v.mean(), rel=1e-14) and r.std == pytest.approx(v.std(), rel=1e-6)  # values far from 0 with a small spread
        assert abs(r.unique_estimate - v.nunique()) <= 0.05 * v.nunique() + 1
        for name, p in Q.items():
            assert (v < r[name]).mean() <= p + 0.02 and (v <= r[name]).mean() >= p - 0.02


def test_histories(spark, table):
    df, pdf = table
    got = {(str(r.period)[:10], r.column): r for r in ss.finished_states(ss.history_states(ss.period_states(df, "ts", ["x", "y"]), 7), ["period", "column"], Q).collect()}
    days = sorted(pdf.ts.unique())
    assert ("2024-01-01", "x") not in got and len(got) == 2 * (len(days) - 1)
    for d in days[1:]:
        before = pdf[(pdf.ts < d) & (pdf.ts >= d - np.timedelta64(7, "D"))]
        for c in "xy":
            r = got[str(d)[:10], c]
            assert r["count"] == before[c].count() and r["max"] == before[c].max() and r.mean == pytest.approx(before[c].mean())


def test_states_survive_a_table(spark, table, tmp_path):
    df, _ = table
    states = ss.period_states(df, "ts", ["y"])
    states.write.parquet(str(tmp_path / "states"))
    again = ss.merged_states(spark.read.parquet(str(tmp_path / "states")), ["column"])
    assert ss.finished_states(again, ["column"], Q).first()["count"] > 0


def test_empty_columns(spark):
    df = spark.createDataFrame([("2024-01-01", None)], "ts string, x double")
    (r,) = ss.finished_states(ss.merged_states(ss.period_states(df, "ts", ["x"]), ["column"]), ["column"], Q).collect()
    assert (r["count"], r.missing_count, r.mean, r["std"], r.q10, r.unique_estimate) == (0, 1, None, None, None, 0)
    assert ss.period_states(df.limit(0), "ts", ["x"]).count() == 0
