"""Labelled series for tests: clean past and future with known anomalies; numbers are hashes of row and seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.season import linear_trend, weekday_pattern


def uniform(seed: int, *by: Column) -> Column:
    """Repeatable number in (0, 1)."""
    return (F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def normal(seed: int, *by: Column) -> Column:
    """Repeatable standard normal number."""
    return F.sqrt(-2 * F.ln(uniform(seed, *by))) * F.cos(2 * math.pi * uniform(seed + 1, *by))


def extend_series(series: DataFrame, keys: list[str], past_days: int = 365, future_days: int = 30, anomaly_percent: float = 20, seed: int = 42,
                  day: str = "day", value: str = "value") -> DataFrame:
    """(keys, day, value, part, has_anomaly): invented clean past, the series itself, and a future with labelled anomalies.

    Every series of the table is extended on both sides. Anomalies lie three to five deviations off the mean.
    """
    facts = series.groupBy(*keys).agg(
        F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.min(day).alias("d0"), F.max(day).alias("d1"),
    ).join(linear_trend(series, keys, day, value), keys)
    week = weekday_pattern(series, keys, day, value).withColumnRenamed("weekday", "_wd")
    by = [F.col(k) for k in keys] + [F.col(day)]

    def spine(first: Column, last: Column) -> DataFrame:
        days = facts.withColumn(day, F.explode(F.sequence(first, last, F.expr("interval 1 day"))))
        return days.withColumn("_wd", F.weekday(day)).join(week, [*keys, "_wd"], "left").withColumn("_o", F.coalesce("offset", F.lit(0.0)))

    past = spine(F.date_sub("d0", past_days), F.date_sub("d0", 1))
    back = F.datediff("d0", day)
    drift = F.when(F.abs("slope") > 0.001, F.col("slope") * back).otherwise(F.lit(0.0))
    buffer = (F.col("hi") - F.col("lo")) * 0.15
    clean = F.col("m") - drift + F.col("_o") + normal(seed, *by) * F.col("s") * 0.6
    clean = F.greatest(F.least(clean, F.col("hi") + buffer), F.col("lo") - buffer)
    past = past.select(*keys, day, clean.alias(value), F.lit("past").alias("part"), F.lit(False).alias("has_anomaly"))

    future = spine(F.date_add("d1", 1), F.date_add("d1", future_days))
    chosen = F.row_number().over(Window.partitionBy(*keys).orderBy(uniform(seed + 200, *by))) <= int(future_days * anomaly_percent / 100)
    usual = F.col("m") + normal(seed + 210, *by) * F.col("s") * 0.7 + F.col("_o")
    strength = 3 + 2 * uniform(seed + 220, *by)
    side = F.when(uniform(seed + 230, *by) > 0.5, F.lit(1)).otherwise(F.lit(-1))
    future = future.withColumn("has_anomaly", chosen)
    future = future.select(*keys, day, F.when(F.col("has_anomaly"), F.col("m") + side * strength * F.col("s")).otherwise(usual).alias(value),
                           F.lit("future").alias("part"), "has_anomaly")
    seen = series.select(*keys, day, value, F.lit("observed").alias("part"), F.lit(False).alias("has_anomaly"))
    return past.unionByName(seen).unionByName(future)
