"""Stored states of periods that merge: counts, moments, extremes, quantile and distinct-value sketches per (period, column).

A table is read once to write its states; profiles of longer spans and histories of any period are then merged from states, without
reading rows again. Counts, moments and extremes of a merged state equal those of the rows (up to the last bits of a sum); quantiles
come from KLL sketches and distinct counts from HyperLogLog sketches, with errors that do not grow by merging. The exact profile stays in
``period_profile``; this is the form for spans that are too long to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.nulls import ratio
from plumbline.operators.counts import numeric_long
from plumbline.operators.profile_state import PC, with_period

KLL = 400  # rank errors of about 0.7%
HLL = 12  # relative errors of about 1.6%


def period_states(df: DataFrame, ts: str, columns: list[str], period: str = "day", label: str = "start", kll: int = KLL, hll: int = HLL) -> DataFrame:
    """(period, column, n, present, lo, hi, mean, m2, zeros, negatives, quantiles, distincts): one state per period and number column."""
    v = F.col("value")
    return numeric_long(with_period(df, ts, period, label), ["period"], columns).groupBy(*PC).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("present"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.kll_sketch_agg_double(v, F.lit(kll)).alias("quantiles"), F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(hll)).alias("distincts"))


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of all periods that share the keys as one state. Squared distances are moved to the common mean, not taken from sums of squares."""
    whole = Window.partitionBy(*keys)  # one row per period: small by construction
    k = F.col("present")
    rows = states.withColumn("_mean", F.try_divide(F.sum(k * F.col("mean")).over(whole), F.sum(k).over(whole)))
    gap = F.col("mean") - F.col("_mean")
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(k).alias("present"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + k * gap * gap).alias("m2"), F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distincts").alias("distincts"))


def finished_states(states: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """keys, count, missing_count, min, max, mean, std, zero_count, negative_count, unique_estimate and one column per quantile."""
    k = F.col("present")
    at = lambda p: F.when(k > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    return states.select(
        *keys, k.alias("count"), (F.col("n") - k).alias("missing_count"), F.col("lo").alias("min"), F.col("hi").alias("max"), "mean",
        F.when(k > 1, F.sqrt(ratio(F.col("m2"), k - 1))).alias("std"), F.col("zeros").alias("zero_count"), F.col("negatives").alias("negative_count"),
        F.hll_sketch_estimate("distincts").alias("unique_estimate"), *[at(p).alias(name) for name, p in quantiles.items()])


def history_states(states: DataFrame, days: int) -> DataFrame:
    """For each period with a state the merged state of the ``days`` days before it, without the period itself.

    Every state is handed to the periods that look back on it: ``days`` copies of a state, never rows.
    """
    targets = states.select(F.col("period").alias("_target"), F.col("column").alias("_column"))
    handed = states.withColumn("_target", F.explode(F.sequence(F.lit(1), F.lit(days))))
    handed = handed.withColumn("_target", F.col("period") + F.make_dt_interval(F.col("_target")))
    wanted = handed.join(targets, (handed["_target"] == targets["_target"]) & (handed["column"] == targets["_column"]), "left_semi")
    return merged_states(wanted.drop("period").withColumnRenamed("_target", "period"), PC)
