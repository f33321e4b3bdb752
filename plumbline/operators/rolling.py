"""Features of period metrics over time, on (period, metric, value) tables: rolling windows, lags, calendar.

These tables hold one row per period and metric, so a window per metric has at most as many rows as there are periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions import calendar

WINDOWS = (7, 14, 30, 90)
LAGS = (1, 2, 3)
EPS = 1e-8


def rolling_features(metrics: DataFrame, windows: tuple[int, ...] = WINDOWS, threshold: float = 3.0) -> DataFrame:
    """(period, metric, value, window, mean, std, min, max, zscore, anomaly, trend, diff, ratio); full windows only."""
    order = Window.partitionBy("metric").orderBy("period")
    v = F.col("value")
    rows = metrics.withColumn("_i", F.row_number().over(order))
    per_window = {}
    for w in windows:
        frame = order.rowsBetween(-(w - 1), 0)
        full = F.count(v).over(frame) == w
        per_window[f"_w{w}"] = F.when(full, F.struct(
            F.avg(v).over(frame).alias("mean"), F.stddev_samp(v).over(frame).alias("std"),
            F.min(v).over(frame).alias("min"), F.max(v).over(frame).alias("max"),
            F.regr_slope(v, F.col("_i")).over(frame).alias("trend"),
        ))
    rows = rows.withColumns(per_window)
    long = rows.select("period", "metric", "value", F.explode(F.array(*[
        F.struct(F.lit(w).alias("window"), F.col(f"_w{w}").alias("s")) for w in windows
    ])).alias("x"))
    s = F.col("x.s")
    z = (v - s["mean"]) / (s["std"] + EPS)
    return long.select(
        "period", "metric", "value", F.col("x.window").alias("window"),
        *[s[n].alias(n) for n in ("mean", "std", "min", "max")], z.alias("zscore"),
        F.coalesce((F.abs(z) > threshold).cast("int"), F.lit(0)).alias("anomaly"),
        s["trend"].alias("trend"), (v - s["mean"]).alias("diff"), (v / (s["mean"] + EPS)).alias("ratio"),
    )


def rolling_metrics(rolled: DataFrame) -> DataFrame:
    """(period, metric, value) with the flat names ``{metric}_rolling_7d_mean``, ``{metric}_zscore_7d``, ..."""
    names = {"mean": "rolling", "std": "rolling", "min": "rolling", "max": "rolling"}
    stats = ["mean", "std", "min", "max", "zscore", "anomaly", "trend", "diff", "ratio"]
    wide = rolled.select("period", "metric", "window", *[F.col(c).cast("double").alias(c) for c in stats])
    long = wide.unpivot(["period", "metric", "window"], stats, "_s", "_v")
    w = F.concat(F.col("window").cast("string"), F.lit("d"))
    flat = F.when(F.col("_s").isin(*names), F.concat_ws("_", "metric", F.lit("rolling"), w, "_s")).otherwise(
        F.concat_ws("_", "metric", "_s", w)
    )
    return long.select("period", flat.alias("metric"), F.col("_v").alias("value"))


def lag_features(metrics: DataFrame, lags: tuple[int, ...] = LAGS, base_only: bool = True) -> DataFrame:
    """(period, metric, lag, lagged, diff): earlier values and the change since; gaps are 0.

    With ``base_only`` metrics with a derived name get no lags.
    """
    src = metrics
    if base_only:
        derived = F.lit(False)
        for mark in vocab.LAG_EXCLUDED_MARKS:
            derived = derived | F.col("metric").contains(mark)
        src = metrics.where(~derived)
    order = Window.partitionBy("metric").orderBy("period")
    rows = src.select("period", "metric", "value", F.array(*[
        F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(order).alias("lagged")) for k in lags
    ]).alias("_l"))
    return rows.select("period", "metric", "value", F.inline("_l")).select(
        "period", "metric", "lag", F.coalesce("lagged", F.lit(0.0)).alias("lagged"),
        F.coalesce(F.col("value") - F.col("lagged"), F.lit(0.0)).alias("diff"),
    )


def lag_metrics(lagged: DataFrame) -> DataFrame:
    """(period, metric, value) with the flat names ``{metric}_lag_1d`` and ``{metric}_diff_lag_1d``."""
    return lagged.select("period", "metric", "lag", F.inline(F.array(
        F.struct(F.concat(F.col("metric"), F.lit("_lag_"), F.col("lag"), F.lit("d")).alias("_m"), F.col("lagged").alias("value")),
        F.struct(F.concat(F.col("metric"), F.lit("_diff_lag_"), F.col("lag"), F.lit("d")).alias("_m"), F.col("diff").alias("value")),
    ))).select("period", F.col("_m").alias("metric"), "value")


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Adds weekday (Monday 0), day, month, month end and quarter end."""
    d = F.col(ts)
    return df.withColumns({
        "day_of_week": calendar.day_of_week(d), "day_of_month": F.dayofmonth(d), "month": F.month(d),
        "is_month_end": calendar.is_month_end(d), "is_quarter_end": calendar.is_quarter_end(d),
    })


def feature_table(metrics: DataFrame, windows: tuple[int, ...] = WINDOWS, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Base, rolling and lag metrics in one (period, metric, value) table; missing values are 0."""
    out = metrics.unionByName(rolling_metrics(rolling_features(metrics, windows))).unionByName(
        lag_metrics(lag_features(metrics, lags))
    )
    return out.withColumn("value", F.coalesce("value", F.lit(0.0)))
