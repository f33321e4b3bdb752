import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import layers, panel, rolling, season, sequence
from tests import labelled


def weekly(spark, n=90):
    bump = [50, 30, 40, 60, 200, 300, 250]
    rng = np.random.default_rng(0)
    days = pd.date_range("2023-01-01", periods=n)
    pdf = pd.DataFrame({"metric": "m", "day": days.date, "value": [1000 + bump[d.weekday()] + 2 * i + rng.normal(0, 20) for i, d in enumerate(days)]})
    return spark.createDataFrame(pdf), pdf


def test_recomposed_equals_the_original(spark):
    s, _ = weekly(spark)
    parts = season.decompose(s, ["metric"])
    back = season.recompose(parts.select("metric", "day", "deseasonalized"), parts, ["metric", "day"]).join(s, ["metric", "day"])
    assert back.agg(F.max(F.abs(F.col("recomposed") - F.col("value")))).first()[0] < 1e-10
    assert abs(parts.select("seasonal", F.weekday("day").alias("w")).distinct().agg(F.sum("seasonal")).first()[0]) < 1e-6


def test_short_series_have_no_parts(spark):
    s, _ = weekly(spark, 10)
    assert season.decompose(s, ["metric"]).where("seasonal is not null").count() == 0


def test_weekly_season_is_found(spark):
    s, _ = weekly(spark, 200)
    r = season.autocorrelation(s, ["metric"]).where("lag = 7").first()
    assert r.significant and r.acf > 0.3


def test_halo_windows_equal_plain_windows_for_a_hot_entity(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"e": ["hot"] * 300 + list("abc") * 20, "day": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 200, 360), "D"),
                        "k": range(360), "v": rng.normal(size=360)})
    df = spark.createDataFrame(pdf).withColumn("day", F.to_date("day")).withColumn("c", F.trunc("day", "month"))
    plain = Window.partitionBy("e").orderBy("day", "k").rowsBetween(-6, 0)
    inside = Window.partitionBy("e", "c").orderBy("day", "k").rowsBetween(-6, 0)
    want = {r.k: r.m for r in df.select("k", F.sum("v").over(plain).alias("m")).collect()}
    got = {r.k: r.m for r in panel.with_halo(df, panel.chunk_tails(df, ["e"], "c", ["day", "k"], 6), ["e"], "c", 6).select("k", "_halo", F.sum("v").over(inside).alias("m")).where("not _halo").collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_gap_fill(spark):
    rows = [("a", "2024-01-02", 1, 5.0), ("a", "2024-01-04", 2, None), ("a", "2024-01-04", 3, 7.0), ("b", "2024-01-01", 4, 1.0), ("c", "2024-01-01", 5, 2.0), ("c", "2024-01-05", 6, None)]
    df = spark.createDataFrame(rows, "e string, d string, k int, v double").withColumn("ts", F.to_timestamp("d"))
    got = panel.gap_fill(df, "e", "ts", ["v"], "k").orderBy("e", "day", "k").collect()
    by = lambda e: [(str(r.day)[-2:], r.k, r.v) for r in got if r.e == e]
    assert by("a") == [("01", None, 5.0), ("02", 1, 5.0), ("03", None, 5.0), ("04", 2, 7.0), ("04", 3, 7.0), ("05", None, 7.0)]
    assert by("b") == []
    assert [v for *_, v in by("c")] == [2.0] * 5


def test_interpolation_equals_pandas(spark):
    v = [None, 1.0, None, None, 4.0, None, 2.0, None]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(v)], "m string, i int, value double")
    got = [r.value for r in panel.interpolate(df, ["m"], "i").orderBy("i").collect()]
    want = pd.Series(v, dtype=float).interpolate("linear")
    assert got[0] is None and np.allclose(got[1:], want[1:])


@pytest.mark.parametrize("w", [3, 7])
def test_rolling_equals_pandas(spark, w):
    pdf = pd.DataFrame({"period": pd.date_range("2024-01-01", periods=30), "metric": "m", "value": np.random.default_rng(4).normal(size=30)})
    got = rolling.rolling_features(spark.createDataFrame(pdf), (w,)).orderBy("period").toPandas()
    r = pdf.value.rolling(w)
    for name, want in {"mean": r.mean(), "std": r.std(), "min": r.min(), "trend": r.apply(lambda x: np.polyfit(range(len(x)), x, 1)[0])}.items():
        assert np.allclose(got[name].astype(float), want, equal_nan=True), name
    z = (pdf.value - r.mean()) / (r.std() + 1e-8)
    assert np.allclose(got.zscore.astype(float), z, equal_nan=True)


def test_injected_anomalies_are_found(spark):
    s, _ = weekly(spark, 120)
    both = labelled.extend_series(s, ["metric"], 200, 40)
    assert both.where("has_anomaly").count() == 8 and both.where("part = 'past'").count() == 200
    flagged = layers.statistical_layer(both, ["metric"], "day", sigma=2.0)
    hit = flagged.where("has_anomaly").agg(F.avg(F.col("statistical_anomaly").cast("int"))).first()[0]
    assert hit >= 0.75


def test_extension_does_not_depend_on_partitioning(spark):
    s, _ = weekly(spark, 60)
    a = labelled.extend_series(s.coalesce(1), ["metric"], 30, 20).orderBy("day").collect()
    b = labelled.extend_series(s.repartition(5), ["metric"], 30, 20).orderBy("day").collect()
    assert [(r.day, r.has_anomaly) for r in a] == [(r.day, r.has_anomaly) for r in b]
    assert np.allclose([r.value for r in a], [r.value for r in b])


def test_sequences_are_full_windows(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(5)], "k string, t int, v double")
    rows = sequence.sliding_sequences(df, ["k"], "t", ["v"], 3).orderBy("t").collect()
    assert [[x.v for x in r.sequence] for r in rows] == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]


def test_reconstruction_is_exact_with_all_components(spark):
    df = spark.createDataFrame([("s", i, float(i * i % 7), float(i % 5)) for i in range(40)], "k string, t int, a double, b double")
    seq = sequence.sliding_sequences(df, ["k"], "t", ["a", "b"], 3)
    full = sequence.reconstruction_errors(seq, ["k", "t"], ["a", "b"], 6)
    few = sequence.reconstruction_errors(seq, ["k", "t"], ["a", "b"], 1)
    assert full.agg(F.max("error")).first()[0] < 1e-9 < few.agg(F.max("error")).first()[0]
    r = few.first()
    assert abs(sum(r.feature_errors.values()) / 2 - r.error) < 1e-9
