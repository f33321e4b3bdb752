"""Flags and scores of periods from (period, metric, value) tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions.nulls import ratio

HIGHEST_NULL_SHARE = 0.3


def _without(metrics: DataFrame, exclude) -> DataFrame:
    return reduce(lambda df, x: df.where(~F.col("metric").contains(x)), exclude, metrics)


def _scored(metrics: DataFrame, exclude=()) -> DataFrame:
    """Every metric row with the facts all flags need, from one shuffle by metric.

    A metric has one row per period, so these windows stay small. Metrics that miss more than 30% of all periods go.
    """
    whole = Window.partitionBy("metric")
    line = whole.orderBy("period")
    v = F.col("value")
    periods = metrics.select("period").distinct().agg(F.count(F.lit(1)).cast("double")).scalar()
    rows = _without(metrics, exclude).withColumns({
        "_present": F.count(v).over(whole), "_mean": F.avg(v).over(whole), "_std": F.stddev_samp(v).over(whole),
        "_q": F.percentile(v, [0.25, 0.75]).over(whole), "change": _change(line),
    })
    rows = rows.withColumns({"_cmean": F.avg("change").over(whole), "_cstd": F.stddev_samp("change").over(whole)})
    return rows.where(F.lit(1.0) - F.col("_present") / periods <= HIGHEST_NULL_SHARE)


def _change(line) -> Column:
    now = F.last("value", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("value", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return ratio(now - before, before)


def _flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0)).alias("flag")


def _zscore(threshold: float) -> tuple[Column, Column, Column]:
    """(applies, score, flag)"""
    z = F.abs((F.col("value") - F.col("_mean")) / F.nullif("_std", F.lit(0.0)))
    return F.col("_std") > 0, z, _flag(z > threshold)


def _iqr(factor: float = 1.5) -> tuple[Column, Column, Column]:
    v, q1, q3 = F.col("value"), F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    distance = F.when(v.isNotNull(), F.greatest(low - v, v - high, F.lit(0.0)) / F.nullif(q3 - q1, F.lit(0.0)))
    return q3 > q1, distance, _flag((v < low) | (v > high))


def _rate(threshold: float, marked_only: bool) -> tuple[Column, Column, Column]:
    z = F.abs((F.col("change") - F.col("_cmean")) / F.nullif("_cstd", F.lit(0.0)))
    applies = F.col("_cstd") > 0
    if marked_only:
        applies = applies & reduce(lambda a, b: a | b, [F.col("metric").contains(m) for m in vocab.RATE_MARKS])
    return applies, z, _flag(z > threshold)


def _only(metrics: DataFrame, exclude, kind: tuple[Column, Column, Column]) -> DataFrame:
    applies, score, flag = kind
    return _scored(metrics, exclude).where(applies).select("period", "metric", score.alias("score"), flag)


def zscore_flags(metrics: DataFrame, threshold: float = 3.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(period, metric, score, flag): distance from the metric's mean in deviations; flat or sparse metrics are left out."""
    return _only(metrics, exclude, _zscore(threshold))


def iqr_flags(metrics: DataFrame, exclude: tuple[str, ...] = (), factor: float = 1.5) -> DataFrame:
    """(period, metric, score, flag): distance beyond the quartile fences in units of the quartile range."""
    return _only(metrics, exclude, _iqr(factor))


def relative_changes(metrics: DataFrame) -> DataFrame:
    """Adds ``change``: relative change to the period before, over forward-filled values; NULL on a zero base."""
    return metrics.withColumn("change", _change(Window.partitionBy("metric").orderBy("period")))


def rate_flags(metrics: DataFrame, threshold: float = 3.0, exclude: tuple[str, ...] = (), marked_only: bool = True) -> DataFrame:
    """(period, metric, score, flag): unusual relative change; ``marked_only`` limits to rate-like metric names."""
    return _only(metrics, exclude, _rate(threshold, marked_only))


def correlation_flags(metrics: DataFrame, threshold: float = 3.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Z-score flags of correlation metrics."""
    return zscore_flags(metrics, threshold, exclude).where(F.col("metric").startswith("corr_"))


def all_flags(metrics: DataFrame, threshold: float = 3.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The four kinds of flags in one table with ``kind``. Correlation metrics count under z-score and correlation."""
    z, q, r = _zscore(threshold), _iqr(), _rate(threshold, True)
    kinds = {"zscore": z, "iqr": q, "change": r, "correlation": (z[0] & F.col("metric").startswith("corr_"), z[1], z[2])}
    items = [F.when(applies, F.struct(F.lit(k).alias("kind"), score.alias("score"), flag)) for k, (applies, score, flag) in kinds.items()]
    rows = _scored(metrics, exclude).withColumn("_k", F.array_compact(F.array(*items)))
    return rows.select("period", "metric", F.inline("_k"))


def combine_flags(metrics: DataFrame, flags: DataFrame, min_flags: int = 3, weighted: bool = True) -> DataFrame:
    """(period, total_anomalies, anomaly_score, is_anomaly) for every period.

    Weighted scores add the distance of each flagged metric and are scaled so that the worst period has 10; plain scores
    count flags.
    """
    weight = F.coalesce("score", F.lit(0.0)) * F.col("flag") if weighted else F.col("flag").cast("double")
    sums = flags.groupBy("period").agg(F.sum("flag").alias("_t"), F.sum(weight).alias("_s"))
    out = metrics.select("period").distinct().join(sums, "period", "left").select(
        "period", F.coalesce("_t", F.lit(0)).alias("total_anomalies"), F.coalesce("_s", F.lit(0.0)).alias("anomaly_score")
    )
    if weighted:
        top = sums.agg(F.max("_s")).scalar()
        out = out.withColumn("anomaly_score", F.when(top > 0, F.col("anomaly_score") / top * 10).otherwise(F.col("anomaly_score")))
    return out.withColumn("is_anomaly", (F.col("total_anomalies") >= min_flags).cast("int"))


def score_periods(metrics: DataFrame, threshold: float = 3.0, min_flags: int = 3, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Which periods look wrong: all flags, combined and scaled."""
    return combine_flags(metrics, all_flags(metrics, threshold, exclude), min_flags)


# Flags of engineered metrics.

def zscore_metric_flags(metrics: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(period, metric, flag): flags ``{base}_anomaly_{window}`` from metrics named ``{base}_zscore_{window}``."""
    src = metrics.where(F.col("metric").contains("_zscore_"))
    return src.select("period", F.regexp_replace("metric", "_zscore_", "_anomaly_").alias("metric"), _flag(F.abs("value") > threshold))


def widest_zscore(rolled: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(period, metric, max_zscore, any_anomaly): largest absolute z-score over all windows."""
    out = rolled.groupBy("period", "metric").agg(F.max(F.abs("zscore")).alias("max_zscore"))
    return out.withColumn("any_anomaly", F.coalesce((F.col("max_zscore") > threshold).cast("int"), F.lit(0)))


def target_flags(flags: DataFrame, target: str = "target") -> DataFrame:
    """(period, target, any_anomaly, anomaly_count)."""
    return flags.groupBy("period", target).agg(F.max("flag").alias("any_anomaly"), F.sum("flag").alias("anomaly_count"))


def combined_scores(features: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(period, column, combined_score, combined_flag) from (period, column, metric, value) of drift features.

    Each drift feature is standardised over the periods; the score is the mean absolute value over the features of the
    column. Flat features do not count; a period that misses one of the others has no score.
    """
    drift = reduce(lambda a, b: a | b, [F.col("metric").contains(m) for m in ("_diff_", "_ratio_", "_zscore_")])
    src = features.where(drift)
    per = Window.partitionBy("column", "metric")
    rows = src.withColumns({"_mean": F.avg("value").over(per), "_std": F.stddev_samp("value").over(per)}).where(F.col("_std") > 0)
    used = rows.groupBy("column").agg(F.count_distinct("metric").alias("_used"))
    sums = rows.groupBy("period", "column").agg(
        F.avg(F.abs((F.col("value") - F.col("_mean")) / F.col("_std"))).alias("_score"), F.count("value").alias("_have")
    )
    score = F.when(F.col("_have") == F.col("_used"), F.col("_score"))
    return sums.join(used, "column").select("period", "column", score.alias("combined_score"),
                                            F.coalesce((score > threshold).cast("int"), F.lit(0)).alias("combined_flag"))
