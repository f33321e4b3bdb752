"""Sequences over period metrics: sliding windows, prediction error scores, low-rank reconstruction errors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.nulls import bounded, ratio
from plumbline.operators.counts import quantiles


def sliding_sequences(series: DataFrame, keys: list[str], order: str, features: list[str], length: int) -> DataFrame:
    """(keys, order, sequence): the last ``length`` rows as an array of structs, full windows only."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    out = series.withColumn("sequence", F.collect_list(F.struct(*features)).over(w))
    return out.where(F.size("sequence") == length).select(*keys, order, "sequence")


def prediction_errors(metrics: DataFrame, length: int = 14) -> DataFrame:
    """(period, error): mean over metrics of the squared distance to the mean of the previous ``length`` values.

    Periods without a full past have no error.
    """
    line = Window.partitionBy("metric").orderBy("period")
    past = line.rowsBetween(-length, -1)
    v = F.coalesce("value", F.lit(0.0))
    full = F.count(F.lit(1)).over(past) == length
    rows = metrics.select("period", F.when(full, F.pow(v - F.avg(v).over(past), F.lit(2.0))).alias("_e"))
    return rows.groupBy("period").agg(F.avg("_e").alias("error"))


def sequence_scores(metrics: DataFrame, train: DataFrame | None = None, length: int = 14, percentile: float = 0.95) -> DataFrame:
    """(period, error, score, flag): error over the training quantile; the first periods get the mean training error.

    ``train`` holds the training rows of ``metrics`` (all rows if not given); values should be scaled.
    """
    base = prediction_errors(metrics if train is None else train, length).where(F.col("error").isNotNull())
    facts = quantiles(base.select(F.lit(0).alias("_k"), F.col("error").alias("value")), ["_k"], {"limit": percentile}, buckets=1).join(
        base.agg(F.lit(0).alias("_k"), F.avg("error").alias("mean")), "_k"
    ).select(F.struct("limit", "mean")).scalar()
    out = prediction_errors(metrics, length)
    score = F.coalesce(ratio(F.col("error"), facts["limit"]), ratio(facts["mean"], facts["limit"]))
    return out.withColumn("score", score).withColumn("flag", (F.col("score") >= 1.0).cast("int"))


def prefix_forecast_scores(metrics: DataFrame, length: int = 14, train_share: float = 0.7, least: int = 30, highest_null_share: float = 0.3,
                           percentile: float = 0.95, threshold: float = 0.5) -> DataFrame:
    """(period, max_score, flag): forecast errors after a training prefix, per metric, largest over the metrics.

    Gaps are filled forward, then backward. Metrics that are short or sparse are left out; training rows score 0.
    """
    line = Window.partitionBy("metric").orderBy("period")
    whole = Window.partitionBy("metric")
    ahead, behind = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    rows = metrics.withColumns({
        "_i": F.row_number().over(line), "_n": F.count(F.lit(1)).over(whole), "_have": F.count("value").over(whole),
        "_v": F.coalesce(F.last("value", True).over(ahead), F.first("value", True).over(behind)),
    }).where((F.col("_n") >= least) & (1 - F.col("_have") / F.col("_n") <= highest_null_share))
    past = line.rowsBetween(-length, -1)
    full = F.count("_v").over(past) == length
    rows = rows.withColumn("_e", F.when(full, F.pow(F.col("_v") - F.avg("_v").over(past), F.lit(2.0))))
    training = F.col("_i") <= F.floor(F.col("_n") * train_share)
    limits = quantiles(rows.where(training & F.col("_e").isNotNull()).select("metric", F.col("_e").alias("value")), ["metric"],
                       {"_limit": percentile}, buckets=1)
    scored = rows.join(limits, "metric").withColumn("_s", F.when(training, F.lit(0.0)).otherwise(F.coalesce(ratio(F.col("_e"), F.col("_limit")), F.lit(0.0))))
    out = scored.groupBy("period").agg(F.max("_s").alias("max_score"))
    return out.withColumn("flag", (F.col("max_score") > threshold).cast("int"))


def reconstruction_errors(sequences: DataFrame, keys: list[str], features: list[str], components: int = 5, train: DataFrame | None = None) -> DataFrame:
    """(keys, error, feature_errors): distance of each sequence to its projection on the main components.

    ``sequences`` come from :func:`sliding_sequences` with fields in ``features`` order. The components are fitted on
    ``train``; the model is length*features wide, which does not grow with the rows.
    """
    flat = lambda df: df.select(*keys, F.flatten(F.transform("sequence", lambda s: F.array(*[bounded(s[f]) for f in features]))).alias("_x"))
    rows = flat(sequences)
    fit = (flat(train) if train is not None else rows).withColumn("_v", array_to_vector("_x"))
    width = len(fit.select("_x").first()[0])
    means = fit.agg(*[F.avg(F.get("_x", F.lit(i))).alias(f"m{i}") for i in range(width)]).first()
    mean = np.array([means[f"m{i}"] for i in range(width)])
    basis = PCA(k=min(components, width), inputCol="_v", outputCol="_p").fit(fit).pc.toArray()
    n_features = len(features)
    numbers = lambda v: F.array(*[F.lit(float(a)) for a in v])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    # what the components leave over, with one row of weights per place of the sequence
    left = F.array(*[numbers(r) for r in np.eye(width) - basis @ basis.T])
    out = rows.withColumn("_d", F.zip_with("_x", numbers(mean), lambda x, m: x - m)).withColumn("_g", F.transform(left, lambda r: dot(r, F.col("_d"))))
    of = lambda i: F.filter("_g", lambda _, at: at % n_features == i)
    mean_square = lambda v: dot(v, v) / F.size(v)
    out = out.withColumn("_f", F.array(*[mean_square(of(i)) for i in range(n_features)]))
    total = F.aggregate("_f", F.lit(0.0), lambda a, x: a + x) / n_features
    named = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.col("_f"))
    return out.select(*keys, total.alias("error"), named.alias("feature_errors"))


def reconstruction_scores(errors: DataFrame, series: list[str], order: str, tail: float = 0.2, percentile: float = 0.95) -> DataFrame:
    """Adds threshold (quantile over the last ``tail`` of the series' sequences), score and is_anomaly."""
    placed = errors.withColumn("_r", F.percent_rank().over(Window.partitionBy(*series).orderBy(order)))
    last = placed.where(F.col("_r") >= 1 - tail).select(*series, F.col("error").alias("value"))
    out = placed.drop("_r").join(quantiles(last, series, {"threshold": percentile}, buckets=1), series)
    return out.withColumn("score", ratio(F.col("error"), F.col("threshold"))).withColumn("is_anomaly", F.col("error") > F.col("threshold"))


def contributions(feature_errors: DataFrame) -> DataFrame:
    """(feature, contribution, rank) from (key, feature, error, is_anomaly): mean error in anomalies over that in normals."""
    bad = F.avg(F.when(F.col("is_anomaly"), F.col("error")))
    good = F.avg(F.when(~F.col("is_anomaly"), F.col("error")))
    out = feature_errors.groupBy("feature").agg((bad / (good + 1e-8)).alias("contribution"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("contribution"), "feature")))


def top_anomalies(feature_errors: DataFrame, key: str, anomalies: int = 5, features: int = 3) -> DataFrame:
    """(key, total, feature, error, rank): the worst keys with their worst features."""
    worst = feature_errors.where("is_anomaly").groupBy(key).agg(F.avg("error").alias("total")).orderBy(F.desc("total"), key).limit(anomalies)
    w = Window.partitionBy(key).orderBy(F.desc("error"), "feature")
    ranked = feature_errors.join(worst, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= features)
    return ranked.select(key, "total", "feature", "error", "rank")


def metric_errors(metrics: DataFrame, length: int = 14) -> DataFrame:
    """(period, feature, error): squared prediction error per metric."""
    past = Window.partitionBy("metric").orderBy("period").rowsBetween(-length, -1)
    full = F.count("value").over(past) == length
    out = metrics.select("period", F.col("metric").alias("feature"), F.when(full, F.pow(F.col("value") - F.avg("value").over(past), F.lit(2.0))).alias("error"))
    return out.where(F.col("error").isNotNull())
