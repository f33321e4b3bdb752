"""Feature selection over (period, metric, value) tables.

Moments are aggregates on Spark. What comes to the driver is features x features at most: correlation matrices and
component loadings, which do not grow with the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.checkpoint import cut

VARIANCE, CORRELATION, SHARE = 0.01, 0.95, 0.95
DENSE = 512  # more metrics than this never meet in one matrix
BLOCK_METRICS, BLOCK_VALUES = 256, 1 << 22


def metric_names(metrics: DataFrame) -> list[str]:
    """Sorted metric names: metadata, one entry per feature."""
    return [r["metric"] for r in metrics.select("metric").distinct().orderBy("metric").collect()]


def vectors(metrics: DataFrame, names: list[str], standardised: bool = False) -> DataFrame:
    """(period, x): one array per period in the order of ``names``; missing is 0."""
    src = metrics.where(F.col("metric").isin(*names)).select("period", "metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    if standardised:
        w = Window.partitionBy("metric")
        s = F.stddev_pop("value").over(w)
        src = src.withColumn("value", F.when(s > 0, (F.col("value") - F.avg("value").over(w)) / s).otherwise(F.lit(0.0)))
    by_name = src.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    order = F.array(*[F.lit(n) for n in names])
    return by_name.select("period", F.transform(order, lambda n: F.coalesce(F.try_element_at("_m", n), F.lit(0.0))).alias("x"))


def variance_filter(metrics: DataFrame, threshold: float = VARIANCE, sample: bool = False) -> DataFrame:
    """(metric, variance, keep)."""
    v = F.coalesce("value", F.lit(0.0))
    out = metrics.groupBy("metric").agg((F.var_samp(v) if sample else F.var_pop(v)).alias("variance"))
    return out.withColumn("keep", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def variance_rank(metrics: DataFrame) -> DataFrame:
    """(metric, variance, rank) by sample variance."""
    out = variance_filter(metrics, 0.0, sample=True).drop("keep")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "metric")))


def _correlated(metrics: DataFrame, names: list[str], threshold: float) -> list[str]:
    if len(names) < 2:
        return []
    m = Correlation.corr(vectors(metrics, names).select(array_to_vector("x").alias("v")), "v").first()[0].toArray()
    high = np.triu(np.nan_to_num(np.abs(m)), k=1) > threshold
    return [n for j, n in enumerate(names) if high[:, j].any()]


def correlation_filter(metrics: DataFrame, names: list[str] | None = None, threshold: float = CORRELATION) -> DataFrame:
    """(metric, keep): the later of two strongly correlated metrics goes; names are taken in the given order, else sorted.

    Without names, more than DENSE metrics are compared block by block, see :func:`wide_correlation_filter`.
    """
    if names is None and metrics.select("metric").distinct().limit(DENSE + 1).count() > DENSE:
        return wide_correlation_filter(metrics, threshold)
    names = names or metric_names(metrics)
    gone = set(_correlated(metrics, names, threshold))
    return metrics.sparkSession.createDataFrame([(n, n not in gone) for n in names], "metric string, keep boolean")


def wide_correlation_filter(metrics: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    """(metric, keep) for any number of metrics: the later name of two strongly correlated ones goes; missing is 0.

    Metrics are dealt to blocks by a hash, every pair of blocks is one matrix product in one task. A block holds at most about
    BLOCK_METRICS metrics and BLOCK_VALUES values, so long histories make smaller blocks. No matrix or list of names comes to the driver.
    """
    metrics = cut(metrics.select("period", "metric", F.coalesce("value", F.lit(0.0)).alias("value")))
    periods = metrics.select("period").distinct().withColumn("_at", F.row_number().over(Window.orderBy("period")) - 1)
    n_periods, n_metrics = metrics.agg(F.count_distinct("period"), F.count_distinct("metric")).first()
    blocks = max(1, -(-n_metrics // max(1, min(BLOCK_METRICS, BLOCK_VALUES // max(1, n_periods)))))
    block = F.pmod(F.xxhash64("metric"), F.lit(blocks)).cast("int")
    series = metrics.join(periods, "period").groupBy("metric").agg(F.collect_list("_at").alias("at"), F.collect_list("value").alias("value"))
    series = series.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = series.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "metric", "at", "value")

    def later(pdf):
        z = np.zeros((len(pdf), n_periods))
        for row, at, value in zip(z, pdf["at"], pdf["value"], strict=True):
            row[at] = value
        z -= z.mean(axis=1, keepdims=True)
        length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        z = np.divide(z, length, out=np.zeros_like(z), where=length > 0)
        names, first = pdf["metric"].to_numpy(), (pdf["block"] == pdf["low"]).to_numpy()
        rows, cols = np.flatnonzero(first), np.arange(len(pdf)) if pdf["low"].iat[0] == pdf["high"].iat[0] else np.flatnonzero(~first)
        a, b = np.nonzero(np.abs(z[rows] @ z[cols].T) > threshold)
        pairs = ((names[rows[i]], names[cols[j]]) for i, j in zip(a, b, strict=True) if rows[i] != cols[j])
        return pd.DataFrame({"metric": pd.Series(sorted({max(p) for p in pairs}), dtype=object)})

    gone = keyed.groupBy("low", "high").applyInPandas(later, "metric string").distinct().withColumn("_gone", F.lit(True))
    return metrics.select("metric").distinct().join(gone, "metric", "left").select("metric", F.col("_gone").isNull().alias("keep"))


def _pca(metrics: DataFrame, names: list[str], k: int):
    rows = vectors(metrics, names, standardised=True).withColumn("v", array_to_vector("x"))
    return rows, PCA(k=k, inputCol="v", outputCol="p").fit(rows)


def component_count(metrics: DataFrame, names: list[str] | None = None, share: float = SHARE, least: int = 1, most: int | None = None) -> int:
    """Components that explain ``share`` of the variance; ``least`` and ``most`` clip the number on request, ``most`` wins."""
    names = names or metric_names(metrics)
    _, model = _pca(metrics, names, len(names))
    need = int(np.argmax(np.cumsum(model.explainedVariance.toArray()) >= share - 1e-12)) + 1
    return min(max(need, least), most or len(names))


def forest_importance(metrics: DataFrame, names: list[str] | None = None, trees: int = 100, seed: int = 42) -> DataFrame:
    """(metric, score): importance in a random forest that predicts the first component."""
    names = names or metric_names(metrics)
    rows, model = _pca(metrics, names, 1)
    raw = vectors(metrics, names).select("period", array_to_vector("x").alias("features"))
    target = model.transform(rows).select("period", vector_to_array("p")[0].alias("label"))
    fit = RandomForestRegressor(numTrees=trees, seed=seed).fit(raw.join(target, "period"))
    scores = fit.featureImportances.toArray()
    return metrics.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, scores)], "metric string, score double")


def reconstruction_rank(metrics: DataFrame, names: list[str] | None = None, components: int | None = None, order: str = "desc") -> DataFrame:
    """(metric, error, rank): mean squared distance to the projection on the main components, worst or best first."""
    names = names or metric_names(metrics)
    k = components or max(1, len(names) // 4)
    rows, model = _pca(metrics, names, k)
    pc = model.pc.toArray()
    keep = pc @ pc.T  # features x features
    d = rows.select("x")
    errors = []
    for i, n in enumerate(names):
        weights = F.array(*[F.lit(float(w)) for w in keep[i]])
        fitted = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        gap = F.get("x", F.lit(i)) - fitted
        errors.append(F.struct(F.lit(n).alias("metric"), F.avg(gap * gap).alias("error")))
    out = d.agg(F.array(*errors).alias("_e")).select(F.inline("_e"))
    by = F.desc("error") if order == "desc" else F.asc("error")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(by, "metric")))


def loading_rank(metrics: DataFrame, names: list[str] | None = None, components: int | None = None) -> DataFrame:
    """(metric, score, rank): summed absolute loadings over ``components`` components, without a number over all."""
    names = names or metric_names(metrics)
    _, model = _pca(metrics, names, min(components or len(names), len(names)))
    scores = np.abs(model.pc.toArray()).sum(axis=1)
    out = metrics.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, scores)], "metric string, score double")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "metric")))


def feature_report(scores: DataFrame, n: int) -> DataFrame:
    """(rank, metric, base_column, metric_type, score): the ``n`` best with the parts of their names."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "metric"))).where(F.col("rank") <= n)
    has = F.col("metric").contains("_")
    return ranked.select("rank", "metric", F.substring_index("metric", "_", 1).alias("base_column"),
                         F.when(has, F.substring_index("metric", "_", -1)).otherwise(F.lit("base")).alias("metric_type"), "score")


def training_folds(metrics: DataFrame, folds: int = 5, mode: str = "growing") -> list[DataFrame]:
    """Training rows of each fold: ``growing`` prefixes of time, or all but one of the ``blocks`` that cover all periods."""
    if mode not in ("growing", "blocks"):
        raise ValueError("mode is growing or blocks")
    numbered = cut(metrics.select("period").distinct().withColumn("_i", F.row_number().over(Window.orderBy("period")) - 1))
    n = numbered.count()
    size = n // (folds + 1)
    out = []
    for f in range(folds):
        if mode == "blocks":
            keep = (F.col("_i") < f * n // folds) | (F.col("_i") >= (f + 1) * n // folds)
        else:
            keep = F.col("_i") < n - size * (folds - f)
        out.append(metrics.join(numbered.where(keep).select("period"), "period", "left_semi"))
    return out


def stable_features(metrics: DataFrame, folds: int = 5, share: float = 0.7, variance: float = 0.001, threshold: float = CORRELATION,
                    most: int | None = None, mode: str = "growing") -> DataFrame:
    """(metric, folds, stability, stable): metrics that pass the variance and correlation filters in most folds.

    With ``most`` each fold keeps that many of them, those that the main components explain best.
    """
    spark = metrics.sparkSession
    metrics = cut(metrics)  # read several times per fold
    chosen = []
    for i, train in enumerate(training_folds(metrics, folds, mode)):
        kept = [r["metric"] for r in variance_filter(train, variance, sample=True).where("keep").orderBy("metric").collect()]
        gone = set(_correlated(train, kept, threshold))
        kept = [k for k in kept if k not in gone]
        if most is not None and len(kept) > most:
            kept = [r["metric"] for r in reconstruction_rank(train, kept, order="asc").where(F.col("rank") <= most).select("metric").collect()]
        chosen.append(spark.createDataFrame([(i, n) for n in kept] or [(i, None)], "fold int, metric string"))
    votes = reduce(DataFrame.unionByName, chosen).where(F.col("metric").isNotNull()).groupBy("metric").agg(F.count(F.lit(1)).alias("folds"))
    return votes.select("metric", "folds", (F.col("folds") / folds).alias("stability"), (F.col("folds") >= int(folds * share)).alias("stable"))


def importance_summary(errors: DataFrame) -> DataFrame:
    """(metric, mean_error, std_error, importance) from (metric, error) rows of several folds."""
    return errors.groupBy("metric").agg(
        F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"), (1 / (F.avg("error") + 1e-8)).alias("importance")
    )


def fold_errors(metrics: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, metric, error): reconstruction errors per fold, for :func:`importance_summary`."""
    metrics = cut(metrics)  # read once per fold
    names = metric_names(metrics)
    parts = [reconstruction_rank(t, names).select(F.lit(i).alias("fold"), "metric", "error") for i, t in enumerate(training_folds(metrics, folds))]
    return reduce(DataFrame.unionByName, parts)
