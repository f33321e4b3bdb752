import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import column_profile, history, period_profile, quality_profile


def close(a, b, tol=1e-9):
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None
    return a is not None and abs(a - b) <= tol * max(1, abs(b))


def edge_table(spark):
    rows = [(1, 1.0, "a", None, 5.0), (2, float("nan"), None, None, 5.0), (3, None, "b", None, 5.0), (4, 3.0, "b", None, 5.0)]
    return spark.createDataFrame(rows, "k int, v double, s string, gone double, flat double")


def test_column_profile_of_gaps_and_constants(spark):
    p = {r.column_name: r for r in column_profile.profile_columns(edge_table(spark)).collect()}
    assert (p["v"].null_count, p["v"].distinct_count, p["v"].mean) == (2, 2, 2.0)
    assert p["v"].null_percentage == 50.0 and p["v"].data_type == "integer"
    assert p["gone"].data_type == "unknown" and p["gone"].min is None and p["gone"].unique_ratio == 0
    assert p["flat"].std == 0 and p["flat"].distinct_count == 1
    assert p["s"].sample_values == "a|b" and p["s"].data_type == "string"


def test_column_profile_of_an_empty_table(spark):
    assert column_profile.profile_columns(edge_table(spark).limit(0)).count() == 0


def test_semantic_types(spark):
    df = spark.createDataFrame([(f"u{i}@mail.org", f"10.0.0.{i}", "2024-01-0%d" % (i % 9 + 1), f"http://x/{i}", "1234%d" % (i % 10)) for i in range(20)],
                               "m string, a string, d string, u string, z string")
    got = {r.column_name: (r.data_type, r.is_pii) for r in column_profile.infer_types(df).collect()}
    assert got == {"m": ("email", True), "a": ("ip_address", True), "d": ("date", False), "u": ("url", False), "z": ("zip_code", False)}


def test_whole_word_names(spark):
    df = spark.createDataFrame([("x", "y")], "description string, client_ip string")
    loose = {r.column_name: r.is_pii for r in column_profile.profile_columns(df).collect()}
    strict = {r.column_name: r.is_pii for r in column_profile.profile_columns(df, whole_word=True).collect()}
    assert loose == {"description": True, "client_ip": True} and strict == {"description": False, "client_ip": True}


def test_approximate_distinct_counts(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("d"))
    p = {r.column_name: r for r in column_profile.profile_columns(df, approx_distinct=True).collect()}
    assert p["d"].distinct_count == 10 and abs(p["id"].distinct_count - 1000) < 100 and p["id"].median == 499.5


def test_window_metrics_equal_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=400, freq="h"), "v": rng.gamma(2, 10, 400)})
    pdf.loc[::7, "v"] = np.nan
    got = {r.period: r for r in period_profile.numeric_metrics(spark.createDataFrame(pdf), "ts", "day").collect()}
    for day, g in pdf.set_index("ts").resample("1D"):
        v, r = g.v.dropna(), got[day.to_pydatetime()]
        for name, want in {"mean": v.mean(), "std": v.std(), "skew": v.skew(), "kurt": v.kurtosis(), "p95": v.quantile(.95), "count": len(v),
                           "missing_count": g.v.isna().sum(), "unique_count": v.nunique()}.items():
            assert close(r[name], want, 1e-6), (name, r[name], want)


def test_all_null_window_is_kept(spark):
    df = spark.createDataFrame([("2024-01-01", None), ("2024-01-02", 1.0), (None, 9.0)], "d string, v double").withColumn("ts", F.to_timestamp("d"))
    rows = {str(r.period)[:10]: r for r in period_profile.numeric_metrics(df, "ts", "day", ["v"]).collect()}
    assert set(rows) == {"2024-01-01", "2024-01-02"}
    assert rows["2024-01-01"].missing_pct == 100.0 and rows["2024-01-01"]["count"] == 0 and rows["2024-01-01"].mean is None
    assert rows["2024-01-02"].std is None and rows["2024-01-02"].entropy == 0


def test_duplicate_rows_with_nulls(spark):
    df = spark.createDataFrame([("2024-01-01", 1, None), ("2024-01-01", 1, None), ("2024-01-01", 1, "x")], "d string, a int, b string")
    r = period_profile.table_metrics(df.withColumn("ts", F.to_timestamp("d")).drop("d"), "ts").first()
    assert (r.row_count, r.column_count, r.duplicate_rows, r.missing_values_total) == (3, 2, 1, 2)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 5, 300), 2)
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "v": v}))
    r = quality_profile.distribution_metrics(df, "ts", "day", ["v"]).first()
    assert r.Histogram == ",".join(str(x) for x in np.histogram(v, bins=10)[0])
    h = np.histogram(v, bins=min(50, len(np.unique(v))))[0]
    p = h[h > 0] / h.sum()
    assert close(r.Entropy, float(-(p * np.log2(p)).sum()))
    assert r.Entropy <= math.log2(50) + 1e-9


def test_constant_column_falls_in_the_middle_bin(spark):
    df = spark.createDataFrame([("2024-01-01", 5.0)] * 4, "d string, v double").withColumn("ts", F.to_timestamp("d"))
    assert quality_profile.distribution_metrics(df, "ts", "day", ["v"]).first().Histogram == "0,0,0,0,0,4,0,0,0,0"


def test_mutual_information_of_identical_columns(spark):
    df = spark.range(100).select(F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    assert close(quality_profile.mutual_information(df, "ts", ["a", "b"]).first().MutualInformation, math.log2(10), 1e-9)


def test_history_uses_the_last_rows_before_a_date(spark):
    rows = [(f"2024-01-{d:02d}", d * 10 + i, float(d + i)) for d in range(1, 6) for i in range(4)]
    df = spark.createDataFrame(rows, "d string, k int, v double").withColumn("ts", F.to_timestamp("d"))
    got = {(str(r.period), r.window): r for r in history.numeric_history(df, "ts", "k", ["v"], (7, 14)).collect()}
    pdf = pd.DataFrame(rows, columns=["d", "k", "v"])
    for d in sorted(pdf.d.unique()):
        past, now = pdf[pdf.d < d].v, pdf[pdf.d == d].v
        for w in (7, 14):
            assert ((d, w) in got) == (len(past) >= w)
            if len(past) >= w:
                last = past.iloc[-w:]
                assert close(got[(d, w)].mean_diff, now.mean() - last.mean()) and close(got[(d, w)].median_diff, now.median() - last.median())


def test_divergence_bounds(spark):
    df = spark.createDataFrame([("2024-01-0%d" % (1 + i // 10), i, "ab"[i // 10 % 2]) for i in range(40)], "d string, k int, c string").withColumn("ts", F.to_timestamp("d"))
    rows = history.category_history(df, "ts", "k", ["c"], (7,)).collect()
    assert len(rows) == 3 and all(-1e-6 <= r.js_distance <= 1 + 1e-6 for r in rows)
    assert all(r.new_categories == 1 for r in rows)
