"""One state per profile: reads of the table, own metrics in every profile, merging of states, nested columns, groups of series."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import column_profile, neighbours, period_profile, profile_state, quality_profile
from plumbline.operators.profile_state import Metric, Registry, mean_of, share_where
from plumbline.plans import detection
from plumbline.plans.windows import ITEM_COLS, own_registry, whole_items
from plumbline.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def reads(df) -> int:
    """Scans of files in the plan as it is written."""
    return len(re.findall(r"^[\s:+\-]*\(?\d*\)?\s*(?:FileScan|Scan parquet)|(?<=- )FileScan", df._jdf.queryExecution().executedPlan().toString(), re.M))


@pytest.mark.parametrize("name", ["period", "quality"])
def test_two_reads(spark, monkeypatch, name):
    counted = []
    for module in (period_profile, quality_profile):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df, real=real: counted.append(reads(df)) or real(df))
    items = whole_items(Tables(spark, FOLDER)).drop("line")
    if name == "period":
        out = period_profile.period_profile(items, "l_shipdate", "month", correlation=ITEM_COLS, business={"a": ITEM_COLS[:2]}, extra=own_registry())
    else:
        out = quality_profile.quality_metrics(items, "l_shipdate", "month", extra=own_registry())
    assert counted and all(n == 1 for n in counted) and sum(counted) + reads(out) == 2
    out.collect()


def test_own_metrics_in_the_column_profile(spark):
    df = spark.createDataFrame([(1.0, "ab"), (2.5, "abcd"), (None, None), (4.0, "")], "x double, s string")
    got = {r.column_name: r for r in column_profile.profile_columns(df, extra=own_registry()).collect()}
    assert got["x"].whole_share == pytest.approx(2 / 3) and got["x"].geometric_mean == pytest.approx(10 ** (1 / 3)) and got["s"].whole_share is None
    assert got["s"].mean_length == 2.0 and got["s"].top_share == pytest.approx(1 / 3) and got["x"].top_share is None


def test_registered_metrics_alone_equal_those_of_the_whole_profile(spark):
    own, items = own_registry(), whole_items(Tables(spark, FOLDER))
    whole = period_profile.period_profile(items, "l_shipdate", "month", skip=("line",), extra=own).where(F.col("metric").rlike("_(" + "|".join(own.names()) + ")$"))
    alone = period_profile.registered_metrics(items, "l_shipdate", own, "month", skip=("line",))
    got, want = ({(r.period, r.metric): r.value for r in x.collect()} for x in (alone, whole))
    assert len(got) > 100 and got == pytest.approx(want, nan_ok=True)
    assert "Window" not in alone._jdf.queryExecution().executedPlan().toString()


def test_states_merge_to_the_state_of_the_whole(spark):
    own = own_registry()
    items = whole_items(Tables(spark, FOLDER))
    months = profile_state.numbers_of(profile_state.value_state(items, "l_shipdate", "month", ITEM_COLS), ITEM_COLS)
    year = F.date_trunc("year", "period").alias("period")
    merged = own.finished(own.merged(own.partial(months, ["period", "column"]).withColumn("period", F.date_trunc("year", "period")), ["period", "column"]), ["period", "column"])
    whole = own.of(months.select(year, "column", "value", "n"), ["period", "column"])
    got, want = (sorted(x.collect()) for x in (merged, whole))
    assert len(got) == len(want) > 20
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_registry_refuses_doubles_and_kinds():
    own = Registry({"a": share_where(lambda v: v > 0)})
    with pytest.raises(ValueError):
        own.register("a", mean_of(lambda v: v))
    with pytest.raises(ValueError):
        own.register("b", Metric({}, lambda p: F.lit(1), kind="date"))


def test_rows_with_nulls_in_other_places_differ(spark):
    df = spark.createDataFrame([("2024-01-01", "a", None), ("2024-01-01", None, "a"), ("2024-01-01", "a", None), ("2024-01-01", None, None)], "ts string, x string, y string")
    state = profile_state.value_state(df, "ts", "day", [], ["x", "y"], rows_of=["x", "y"])
    assert [tuple(r)[1:] for r in profile_state.duplicate_rows(state).collect()] == [(4, 1, 25.0)]


def test_quality_metrics_with_gaps_equal_the_single_operators(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 3, 300), "D"), "a": rng.normal(size=300), "b": rng.integers(0, 5, 300).astype(float), "c": rng.normal(size=300)})
    for c in "abc":
        pdf.loc[rng.random(300) < 0.2, c] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r.period, r.column, r.metric): r.value for r in quality_profile.quality_metrics(df, "ts").collect()}
    for r in quality_profile.mutual_information(df, "ts", ["a", "b", "c"]).collect():
        assert got[r.period, r.column, "MutualInformation"] == pytest.approx(r.MutualInformation)
    for r in quality_profile.correlations(df, "ts", ["a", "b", "c"]).collect():
        assert got[r.period, r.column, f"Correlation_{r.other}"] == pytest.approx(r.correlation)
    for r in quality_profile.basic_metrics(df, "ts").collect():
        assert [got[r.period, r.column, m] for m in ("Mean", "StandardDeviation", "Sum", "count", "missingCount")] == pytest.approx([r.Mean, r.StandardDeviation, r.Sum, r["count"], r.missingCount])


def test_nested_columns_and_errors(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("facts", T.MapType(T.StringType(), T.DoubleType())),
                           T.StructField("deep", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("raw", T.BinaryType())])))])
    rows = [(1, ["a", "bb", None], {"x": 1.5}, [(1, b"12"), (None, None)]), (2, [], {"x": 2.5, "y": 3.5}, []), (3, None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumn("span", F.expr("make_interval(0, 0, 0, 1)"))
    got = {r.column_name: r for r in column_profile.profile_table(df).collect()}
    assert set(got) == {"id", "tags", "tags[]", "facts", "facts.keys[]", "facts.values[]", "deep", "deep[]", "deep[].n", "deep[].raw", "span"}
    assert (got["tags"].data_type, got["tags"].null_count, got["tags"].min_length, got["tags"].max_length) == ("array", 1, 0, 3)
    assert (got["tags[]"].null_count, got["tags[]"].distinct_count, got["tags[]"].max_length) == (1, 2, 2)
    assert (got["facts.values[]"]["min"], got["facts.values[]"]["mean"], got["facts.values[]"]["max"]) == (1.5, 2.5, 3.5)
    assert (got["deep[].raw"].data_type, got["deep[].raw"].max_length, got["deep[].raw"].null_count) == ("binary", 2, 1)
    assert "not profiled" in got["span"].error and got["id"].error is None


def test_groups_and_columns(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2024-01-01", periods=120)
    parts = []
    for g, n in (("big", 3), ("small", 1), (None, 1)):
        for _ in range(n):
            parts.append(pd.DataFrame({"g": g, "ts": days, "x": rng.normal(100, 1, 120), "y": np.full(120, 7.0), "z": np.nan}))
    parts.append(pd.DataFrame({"g": "few", "ts": days[:29], "x": 1.0, "y": 1.0, "z": np.nan}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[(pdf.g == "big") & (pdf.ts == days[90]), "x"] = 160.0
    found = detection.detect_groups(spark.createDataFrame(pdf), ["g"], "ts", ["x", "y", "z", "g", "gone"])
    got = {(r.g, r.column): r for r in found.results.collect()}
    assert set(got) == {(g, c) for g in ("big", "small") for c in ("x", "y", "z", "g", "gone")}
    assert got["big", "x"].anomaly_count >= 1 and str(got["big", "x"].last_anomaly) >= "2024-03-31" and got["big", "x"].row_count == 360 and got["big", "x"].day_count == 120
    assert got["big", "y"].anomaly_count == 0 and got["big", "z"].error == "no values" and got["big", "gone"].error == "no column of this name" and "string" in got["big", "g"].error
    flagged = {str(r.day) for r in found.flags.where("g = 'big' and column = 'x' and any_anomaly").collect()}
    assert "2024-03-31" in flagged
    summary = {(r.fact, r.name): r.n for r in found.summary.collect()}
    assert summary["total_groups", ""] == 2 and summary["anomalies_by_group", "big"] == sum(got["big", c].anomaly_count or 0 for c in "xy") and summary["anomalies_by_column", "y"] == 0
    empty = detection.detect_groups(spark.createDataFrame(pdf[:0], "g string, ts timestamp, x double, y double, z double"), ["g"], "ts", ["x", "g"])
    assert empty.results.count() == 0 and {r.fact: r.n for r in empty.summary.collect()}["total_groups"] == 0


def test_neighbours_of_saturated_points_stay_near_linear(spark):
    """Three features, of which each point has two at their maximum: comparisons grow with the points, not with their square."""
    def compared(n: int) -> int:
        rng = np.random.default_rng(n)
        pdf = pd.DataFrame(np.ones((n, 3)), columns=list("xyz"))
        pdf.values[np.arange(n), rng.integers(0, 3, n)] = rng.random(n)
        df = spark.createDataFrame(pdf.assign(key=np.arange(n)))
        return neighbours.comparisons(df, "key", ["x", "y", "z"], 10).count()

    small, large = compared(1500), compared(3000)
    assert small < 60 * 10 * 1500 and large < 60 * 10 * 3000 and large < 2.6 * small
