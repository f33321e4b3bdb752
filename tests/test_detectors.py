import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import density, explain, flags, fusion, neighbours, selection
from plumbline.plans import detection


def points(n=300, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": range(n), "a": np.round(rng.gamma(2, 3, n), 1), "b": np.round(rng.normal(0, 5, n), 0)})
    pdf.loc[n - 1, ["a", "b"]] = [300.0, -80.0]
    return pdf


def reference_scores(x, method):
    """Empirical tails over the rows of ``x``, straight from the definition."""
    n = len(x)
    out = np.zeros(n)
    for j in range(x.shape[1]):
        v = x[:, j]
        left = -np.log((v[None, :] <= v[:, None]).sum(1) / n)
        right = -np.log((v[None, :] >= v[:, None]).sum(1) / n)
        skew = np.sign(((v - v.mean()) ** 3).mean())
        by = right if skew > 0 else left if skew < 0 else left + right
        out += np.maximum(np.maximum(left, right), by) if method == "ecod" else np.maximum(by, (left + right) / 2)
    return out


@pytest.mark.parametrize("method", density.METHODS)
def test_tail_scores_equal_brute_force(spark, method):
    pdf = points()
    got = density.out_of_fold(spark.createDataFrame(pdf), "id", ["a", "b"], method, 0.05).toPandas().sort_values("id")
    x = pdf[["a", "b"]].to_numpy()
    assert np.allclose(got.score, reference_scores(x, method))
    for f in range(5):
        train = x[pdf.id % 5 != f]
        limit = np.quantile(reference_scores(train, method), 0.95)
        assert np.allclose(got[got.fold == f].threshold, limit)
    assert got[got.id == 299].flag.item() == 1


def test_tail_scores_with_one_dominant_value(spark):
    pdf = points(400)
    pdf.loc[: 200, "a"] = 0.0
    got = density.tail_scores(spark.createDataFrame(pdf).withColumn("f", F.lit(0)), ["id"], ["a", "b"], "f", [], buckets=8).toPandas().sort_values("id")
    assert len(got) == 400 and np.allclose(got.score, reference_scores(pdf[["a", "b"]].to_numpy(), "ecod"))


@pytest.mark.parametrize("features", [["a"], ["a", "b"]])
def test_neighbours_are_exact(spark, features):
    pdf = points(150)
    nn = neighbours.nearest(spark.createDataFrame(pdf), "id", features, 7).toPandas()
    x = pdf[features].to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i, g in nn.groupby("id"):
        assert np.allclose(np.sort(g.distance), np.sort(d[i])[:7]), i


@pytest.mark.parametrize("features", [["a"], ["a", "b"]])
def test_neighbours_of_repeated_and_tied_points(spark, features):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": range(400), "a": rng.integers(0, 6, 400).astype(float), "b": rng.integers(0, 5, 400).astype(float)})
    pdf.loc[:150, ["a", "b"]] = 2.0
    nn = neighbours.nearest(spark.createDataFrame(pdf), "id", features, 6, leaf=14).toPandas()
    x = pdf[features].to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert len(nn) == 400 * 6
    for i, g in nn.groupby("id"):
        order = sorted((d[i, j], j) for j in range(400) if j != i)[:6]
        assert [(r.distance, r.other) for r in g.sort_values("rank").itertuples()] == [(pytest.approx(v), j) for v, j in order]


@pytest.mark.parametrize("kind", ["log-normal", "clustered", "line"])
def test_comparisons_stay_near_the_number_of_points(spark, kind):
    rng = np.random.default_rng(9)
    for n in (1000, 4000):
        if kind == "clustered":
            x = rng.standard_normal((n, 2)) * 0.01 + rng.integers(0, 5, (n, 1)) ** 3
        else:
            x = np.exp(2 * rng.standard_normal((n, 2)))
        df = spark.createDataFrame(pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1]}))
        made = neighbours.comparisons(df, "id", ["a"] if kind == "line" else ["a", "b"], 10, leaf=32).count()
        assert made <= 32 * n * 10, (n, made)


def test_outlier_factor_is_large_for_the_outlier(spark):
    s = neighbours.local_outlier_factor(spark.createDataFrame(points(150)), "id", ["a", "b"], 10).orderBy(F.desc("score")).first()
    assert s.id == 149 and s.score > 3


def test_mahalanobis_equals_numpy(spark):
    pdf = points(100)
    got = density.mahalanobis(spark.createDataFrame(pdf), ["a", "b"]).toPandas().sort_values("id").score
    x = pdf[["a", "b"]].to_numpy() - pdf[["a", "b"]].to_numpy().mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", x, np.linalg.inv(np.cov(x.T)), x))


def test_clusters_flag_the_far_point(spark):
    out = density.cluster_scores(spark.createDataFrame(points(200)), ["id"], ["a", "b"], contamination=0.02)
    assert out.where("flag = 1").count() <= 5 and out.orderBy(F.desc("score")).first().id == 199


def detectors(spark):
    df = spark.range(50).select("id", (F.col("id") % 10 / 10.0).alias("score"))
    other = spark.range(50).select("id", (F.col("id") % 7 / 7.0).alias("score"))
    mark = lambda d, t: d.withColumn("flag", (F.col("score") > t).cast("int"))
    return mark(df, 0.6), mark(other, 0.5)


def test_intersection_is_inside_union(spark):
    a, b = detectors(spark)
    u = {r.id for r in fusion.union(a, b, ["id"]).collect()}
    i = {r.id for r in fusion.intersection(a, b, ["id"]).collect()}
    assert i and i < u


def test_consensus_is_monotone_in_its_limit(spark):
    a, b = detectors(spark)
    n = [fusion.consensus(a, b, ["id"], consensus_limit=t).where("consensus_anomaly").count() for t in (0.2, 0.5, 0.8)]
    assert n == sorted(n, reverse=True) and n[0] > n[2]


def test_severities(spark):
    rows = [(1.6, 0.9, True), (1.0, 0.5, True), (1.1, 0.4, True), (0.9, 0.2, True), (9.0, 9.0, False)]
    df = spark.createDataFrame(rows, "sequence_score double, density_score double, consensus_anomaly boolean").withColumn(
        "consensus_score", 0.6 * F.col("sequence_score") + 0.4 * F.col("density_score"))
    assert [r.severity for r in fusion.severity(df).collect()] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", None]


def metrics(spark, n=40, odd=39):
    rng = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=n)
    parts = []
    for i, m in enumerate(["x_mean", "y_count", "z_std", "w_max"]):
        v = rng.normal(10 + i, 1, n)
        v[odd] = 60.0
        parts.append(pd.DataFrame({"period": days, "metric": m, "value": v}))
    return spark.createDataFrame(pd.concat(parts))


def test_the_odd_day_is_flagged(spark):
    m = metrics(spark)
    scored = flags.score_periods(m).orderBy("period").collect()
    assert scored[-1].is_anomaly == 1 and scored[-1].anomaly_score == 10.0
    assert sum(r.is_anomaly for r in scored) <= 2
    assert len(scored) == 40


def test_flags_fall_with_the_threshold(spark):
    m = metrics(spark)
    n = [flags.zscore_flags(m, t).agg(F.sum("flag")).first()[0] for t in (1.0, 2.0, 4.0)]
    assert n == sorted(n, reverse=True)


def test_flat_and_sparse_metrics_are_left_out(spark):
    df = metrics(spark).unionByName(metrics(spark).where("metric = 'x_mean'").select("period", F.lit("flat").alias("metric"), F.lit(1.0).alias("value"))).unionByName(
        metrics(spark).where("metric = 'x_mean'").select("period", F.lit("gaps").alias("metric"), F.when(F.dayofmonth("period") % 2 == 0, F.col("value")).alias("value")))
    assert {r.metric for r in flags.zscore_flags(df).select("metric").distinct().collect()} == {"x_mean", "y_count", "z_std", "w_max"}


def test_zero_base_has_no_rate(spark):
    df = spark.createDataFrame([(1, "m", 0.0), (2, "m", 5.0), (3, "m", None), (4, "m", 10.0)], "period int, metric string, value double")
    assert [r.change for r in flags.relative_changes(df).orderBy("period").collect()] == [None, None, 0.0, 1.0]


def test_detection_finds_the_odd_day_and_explains_it(spark):
    m = metrics(spark)
    found = detection.detect_periods(m).where("consensus_anomaly").orderBy(F.desc("consensus_score"))
    first = found.first()
    assert str(first.period)[:10] == "2024-02-09" and first.severity == "CRITICAL" and first.is_target
    e = explain.explanations(explain.top_metrics(explain.contributions(explain.history_facts(m, found.limit(1).select("period")))))
    rows = e.collect()
    assert len(rows) == 4 and all(r.severity == "CRITICAL" and "went up far" in r.explanation for r in rows)


def test_detection_when_rows_arrive_in_another_order_each_time(spark):
    def mixed(batches):  # as shuffles over several machines do
        for b in batches:
            yield b.take(random.SystemRandom().sample(range(b.num_rows), b.num_rows))

    days = metrics(spark).withColumn("value", F.col("value") / 3).coalesce(1)
    want = {r.period: r for r in detection.detect_periods(days).collect()}
    got = detection.detect_periods(days.mapInArrow(mixed, days.schema)).collect()
    assert len(got) == len(want) == 40
    for r in got:
        assert r.density_score == pytest.approx(want[r.period].density_score) and r.sequence_score == pytest.approx(want[r.period].sequence_score)


def test_first_period_has_no_history(spark):
    m = metrics(spark)
    first = m.select("period").distinct().orderBy("period").limit(1)
    rows = explain.explanations(explain.top_metrics(explain.contributions(explain.history_facts(m, first)))).collect()
    assert len(rows) == 4 and all(r.severity == "UNKNOWN" and r.importance == 0 and r.baseline is None for r in rows)


def test_correlated_features_drop_the_later_one(spark):
    m = metrics(spark)
    twin = m.where("metric = 'x_mean'").select("period", F.lit("zz").alias("metric"), (F.col("value") * -2).alias("value"))
    kept = {r.metric: r.keep for r in selection.correlation_filter(m.where("period < '2024-02-09'").unionByName(twin.where("period < '2024-02-09'"))).collect()}
    assert kept == {"w_max": True, "x_mean": True, "y_count": True, "z_std": True, "zz": False}


def test_forest_and_loadings_cover_all_features(spark):
    m = metrics(spark)
    assert selection.forest_importance(m, trees=5).agg(F.sum("score")).first()[0] == pytest.approx(1.0)
    assert selection.loading_rank(m).count() == 4 and selection.component_count(m) == 1 and selection.component_count(m, least=2) == 2
