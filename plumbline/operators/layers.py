"""Layered detection on series (keys, order, value): statistical, seasonal and error-threshold layers, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.calendar import season_position
from plumbline.operators.counts import BUCKETS, on_keys, quantiles


def statistical_layer(series: DataFrame, keys: list[str], order: str, value: str = "value", window: int = 20, sigma: float = 3.0) -> DataFrame:
    """Adds value_anomaly, trend_anomaly, volatility_anomaly and statistical_anomaly (any of them).

    Value: distance from the mean of the series. Trend: distance from the mean of the previous ``window`` values.
    Volatility: deviation of the previous ``window`` values against its own previous ``window`` values. Meant for one
    value per key and period; bring raw rows to that grain first.
    """
    whole = Window.partitionBy(*keys)
    line = Window.partitionBy(*keys).orderBy(order)
    past = line.rowsBetween(-window, -1)
    v = F.col(value)
    rows = series.withColumns({
        "_gm": F.avg(v).over(whole), "_gs": F.stddev_pop(v).over(whole), "_i": F.row_number().over(line) - 1,
        "_pm": F.avg(v).over(past), "_ps": F.stddev_pop(v).over(past),
    })
    vol = F.when(F.col("_i") >= window, F.col("_ps"))
    rows = rows.withColumn("_vol", vol).withColumns({"_vm": F.avg("_vol").over(past), "_vs": F.stddev_pop("_vol").over(past)})
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = rows.withColumns({
        "value_anomaly": yes(F.abs(v - F.col("_gm")) > sigma * F.col("_gs")),
        "trend_anomaly": yes((F.col("_i") >= window) & (F.abs(v - F.col("_pm")) > sigma * F.col("_ps"))),
        "volatility_anomaly": yes((F.col("_i") >= 2 * window) & (F.abs(F.col("_vol") - F.col("_vm")) > sigma * F.col("_vs"))),
    })
    out = out.withColumn("statistical_anomaly", F.col("value_anomaly") | F.col("trend_anomaly") | F.col("volatility_anomaly"))
    return out.drop("_gm", "_gs", "_i", "_pm", "_ps", "_vol", "_vm", "_vs")


def seasonal_layer(df: DataFrame, keys: list[str], ts: str, value: str = "value", periods: tuple[int, ...] = (7,), sigma: float = 3.0,
                   least: int = 6) -> DataFrame:
    """Adds seasonal_anomaly: the value lies far from the mean of its place in any of the seasons.

    Place statistics are one small aggregate per season joined back, so raw rows of any number can be scored.
    """
    out = df
    names = []
    for p in periods:
        name = f"_season_{p}"
        names.append(name)
        placed = out.withColumn("_pos", season_position(F.col(ts), p))
        facts = placed.groupBy(*keys, "_pos").agg(
            F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")
        )
        totals = facts.groupBy(*keys).agg(F.sum("_n").alias("_total")) if keys else facts.agg(F.sum("_n").alias("_total")).withColumn("_one", F.lit(1))
        if not keys:
            facts = facts.withColumn("_one", F.lit(1))
        facts = on_keys(facts, totals, keys or ["_one"]).where((F.col("_n") >= least) & (F.col("_total") >= 2 * p))
        far = F.abs(F.col(value) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-8)) > sigma
        side = facts.select(*keys, "_pos", "_m", "_s")
        joined = on_keys(placed, side if keys else F.broadcast(side), [*keys, "_pos"], "left")  # without keys: one row per place in the season
        out = joined.withColumn(name, F.coalesce(far, F.lit(False))).drop("_pos", "_m", "_s")
    hit = reduce(lambda a, b: a | b, [F.col(n) for n in names])
    return out.withColumn("seasonal_anomaly", hit).drop(*names)


def error_threshold(errors: DataFrame, keys: list[str], error: str = "error", method: str = "gaussian", contamination: float = 0.01,
                    sigma: float = 3.0, buckets: int = BUCKETS) -> DataFrame:
    """(keys, threshold): mean + sigma deviations, or the (1 - contamination) quantile."""
    if method == "gaussian":
        return errors.groupBy(*keys).agg((F.avg(error) + sigma * F.stddev_pop(error)).alias("threshold"))
    if method == "percentile":
        return quantiles(errors.withColumnRenamed(error, "value"), keys, {"threshold": 1 - contamination}, buckets=buckets)
    raise ValueError("method must be 'gaussian' or 'percentile'")


def error_layer(errors: DataFrame, keys: list[str], error: str = "error", **how) -> DataFrame:
    """Adds threshold and error_anomaly (strictly above)."""
    limit = error_threshold(errors, keys, error, **how)
    return on_keys(errors, limit, keys).withColumn("error_anomaly", F.col(error) > F.col("threshold"))


def all_layers(statistical: DataFrame, seasonal: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, statistical, seasonal, sequence, any_anomaly) by key; a layer without a row for a key says no.

    Sequences start later than the series, which the key takes care of.
    """
    a = statistical.select(*keys, F.col("statistical_anomaly").alias("statistical"))
    b = seasonal.select(*keys, F.col("seasonal_anomaly").alias("seasonal"))
    c = errors.select(*keys, F.col("error_anomaly").alias("sequence"))
    out = a.join(b, keys, "full_outer").join(c, keys, "full_outer")
    no = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    out = out.select(*keys, no("statistical"), no("seasonal"), no("sequence"))
    return out.withColumn("any_anomaly", F.col("statistical") | F.col("seasonal") | F.col("sequence"))


def enough_rows(df: DataFrame, group: list[str], least: int = 30) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    big = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return on_keys(df, big, group, "left_semi")
