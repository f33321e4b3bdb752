"""Seasonality of series: patterns, autocorrelation, classical decomposition, recomposition and explanation.

Series are (keys, day, value) tables with one row per key and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.nulls import ratio

# Season length and least number of points per kind of decomposition.
SEASONS = {"daily": (7, 21), "weekly": (52, 104), "monthly": (12, 24)}


def seasonal_patterns(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(pattern, position, mean, std): by hour, weekday (Monday 0) and month, in one pass with grouping sets."""
    h, d, m = F.hour(ts), F.weekday(ts), F.month(ts)
    rows = df.select(h.alias("hour"), d.alias("weekday"), m.alias("month"), F.col(value).cast("double").alias("_v"))
    out = rows.groupingSets([["hour"], ["weekday"], ["month"]], "hour", "weekday", "month").agg(
        F.grouping_id().alias("_g"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("_v").alias("n")
    )
    name = F.when(F.col("_g") == 3, "daily").when(F.col("_g") == 5, "weekly").otherwise("monthly")
    pos = F.when(F.col("_g") == 3, F.col("hour")).when(F.col("_g") == 5, F.col("weekday")).otherwise(F.col("month"))
    return out.select(name.alias("pattern"), pos.alias("position"), "mean", "std", "n")


def daily_series(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(keys, day, value): mean per day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(F.col(value).cast("double")).alias("value"))


def autocorrelation(series: DataFrame, keys: list[str], order: str = "day", value: str = "value", lags: int = 30) -> DataFrame:
    """(keys, lag, acf, bound, significant) for lags 0 .. ``lags`` over the present values in order."""
    whole = Window.partitionBy(*keys)
    line = Window.partitionBy(*keys).orderBy(order)
    rows = series.where(F.col(value).isNotNull())
    rows = rows.withColumn("_x", F.col(value) - F.avg(value).over(whole))
    lagged = F.array(*[
        F.struct(F.lit(k).alias("lag"), F.lag("_x", k).over(line).alias("_y") if k else F.col("_x").alias("_y")) for k in range(lags + 1)
    ])
    pairs = rows.withColumn("_l", lagged).select(*keys, "_x", F.inline("_l"))
    sums = pairs.groupBy(*keys, "lag").agg(
        F.sum(F.col("_x") * F.col("_y")).alias("_c"), F.sum(F.col("_x") * F.col("_x")).alias("_v"), F.count("_x").alias("_n")
    ).where(F.col("_n") > F.col("lag"))
    acf = ratio(F.col("_c"), F.col("_v"))
    bound = F.lit(1.96) / F.sqrt(F.col("_n"))
    return sums.select(*keys, "lag", acf.alias("acf"), bound.alias("bound"), (F.abs(acf) > bound).alias("significant"))


def seasonality(df: DataFrame, ts: str, value: str) -> DataFrame:
    """One row: has_weekly, has_monthly (autocorrelation at 7 and 30 or the last lag), has_daily (variation over hours)."""
    acf = autocorrelation(daily_series(df, [], ts, value).withColumn("_k", F.lit(0)), ["_k"])
    hours = seasonal_patterns(df, ts, value).where("pattern = 'daily'")
    monthly = F.max_by("significant", F.col("lag"))
    found = acf.agg(
        F.coalesce(F.bool_or(F.when(F.col("lag") > 0, F.col("significant"))), F.lit(False)).alias("has_seasonality"),
        F.coalesce(F.bool_or(F.when(F.col("lag") == 7, F.col("significant"))), F.lit(False)).alias("has_weekly"),
        F.coalesce(monthly, F.lit(False)).alias("has_monthly"),
    )
    spread = hours.agg(((F.count(F.lit(1)) > 1) & (ratio(F.stddev_samp("mean"), F.avg("mean")) > 0.1)).alias("has_daily"))
    return found.withColumn("has_daily", F.coalesce(spread.scalar(), F.lit(False)))


def daily_variation(df: DataFrame, keys: list[str], ts: str, value: str, least: float = 0.1) -> DataFrame:
    """(keys, has_daily): whether the hourly means vary by more than ``least`` of their mean."""
    hours = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.hour(ts).alias("_hour")).agg(F.avg(F.col(value).cast("double")).alias("_mean"))
    varies = (F.count(F.lit(1)) > 1) & (ratio(F.stddev_samp("_mean"), F.avg("_mean")) > least)
    return hours.groupBy(*keys).agg(F.coalesce(varies, F.lit(False)).alias("has_daily"))


def weekday_pattern(series: DataFrame, keys: list[str], day: str = "day", value: str = "value", damping: float = 0.5) -> DataFrame:
    """(keys, weekday, offset): half the distance of the weekday mean from the overall mean."""
    whole = series.groupBy(*keys).agg(F.avg(value).alias("_g"))
    by_day = series.groupBy(*keys, F.weekday(day).alias("weekday")).agg(F.avg(value).alias("_m"))
    return by_day.join(whole, keys).select(*keys, "weekday", ((F.col("_m") - F.col("_g")) * damping).alias("offset"))


def linear_trend(series: DataFrame, keys: list[str], order: str = "day", value: str = "value") -> DataFrame:
    """(keys, slope) of the value over its position."""
    line = Window.partitionBy(*keys).orderBy(order)
    return series.withColumn("_i", F.row_number().over(line) - 1).groupBy(*keys).agg(
        F.coalesce(F.regr_slope(value, "_i"), F.lit(0.0)).alias("slope")
    )


def decompose(series: DataFrame, keys: list[str], order: str = "day", value: str = "value", season: str = "daily") -> DataFrame:
    """Adds trend, seasonal, residual and deseasonalized by classical additive decomposition.

    The trend is the centred mean over one season (NULL at both ends), the seasonal part the mean distance from the
    trend per phase, shifted to sum to zero. Series with too few points get NULL parts.
    """
    period, least = SEASONS[season]
    line = Window.partitionBy(*keys).orderBy(order)
    half = period // 2
    v = F.col(value)
    rows = series.withColumns({"_i": F.row_number().over(line) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    wide = line.rowsBetween(-half, half)
    if period % 2:
        trend = F.when(F.count(v).over(wide) == period, F.avg(v).over(wide))
    else:
        inner = line.rowsBetween(-half + 1, half - 1)
        ends = (F.lag(v, half).over(line) + F.lead(v, half).over(line)) / 2
        trend = F.when(F.count(v).over(wide) == period + 1, (F.sum(v).over(inner) + ends) / period)
    rows = rows.withColumn("trend", F.when(F.col("_n") >= least, trend)).withColumn("_phase", F.pmod("_i", F.lit(period)))
    phases = rows.groupBy(*keys, "_phase").agg(F.avg(v - F.col("trend")).alias("_s"))
    centre = Window.partitionBy(*keys)
    phases = phases.withColumn("seasonal", F.col("_s") - F.avg("_s").over(centre)).drop("_s")
    out = rows.join(phases, [*keys, "_phase"])
    return out.withColumns({
        "residual": v - F.col("trend") - F.col("seasonal"), "deseasonalized": v - F.col("seasonal"),
    }).drop("_i", "_n", "_phase")


def recompose(deseasonalised: DataFrame, parts: DataFrame, keys: list[str], value: str = "deseasonalized") -> DataFrame:
    """Adds ``recomposed`` = deseasonalised value + seasonal part of the same key."""
    return deseasonalised.join(parts.select(*keys, "seasonal"), keys).withColumn("recomposed", F.col(value) + F.col("seasonal"))


def explain_seasonally(parts: DataFrame, keys: list[str], name: str, value: str = "value") -> DataFrame:
    """Adds seasonal_impact_percent, is_anomalous (beyond two deviations after removing the season) and a text."""
    whole = Window.partitionBy(*keys)
    d = F.col("deseasonalized")
    rows = parts.withColumns({"_m": F.avg(d).over(whole), "_s": F.stddev_samp(d).over(whole)})
    pct = F.coalesce(ratio(F.col("seasonal") * 100, F.col(value)), F.lit(0.0))
    distance = F.abs(d - F.col("_m"))
    odd = distance > 2 * F.col("_s")
    text = F.format_string(
        f"{name}: observed %.2f, seasonal effect %+.2f (%.1f%%), underlying %.2f, %s, %.1f deviations from the mean",
        F.col(value), F.col("seasonal"), pct, d, F.when(odd, "anomalous").otherwise("normal"), ratio(distance, F.col("_s")),
    )
    return rows.withColumns({"seasonal_impact_percent": pct, "is_anomalous": odd, "explanation": text}).drop("_m", "_s")
