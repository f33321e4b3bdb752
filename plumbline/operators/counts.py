"""Value counts and what follows from them: ranks, exact quantiles, bins, top values.

Exact order statistics are built for groups of any size. ``percentile`` keeps all values of a group in one task;
here a group is first reduced to its distinct values with counts (map-side combined), then cut into buckets of about
equal numbers of distinct values. Running counts go inside a bucket, the few bucket totals are accumulated apart, so
no task sees more than one bucket even when a single group holds most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from plumbline.functions.nulls import number

BUCKETS = 64
DRAWN = 960  # values of a group that its borders are taken from


def numeric_long(df: DataFrame, keys: list[str], columns: list[str], infinities: bool = False) -> DataFrame:
    """(keys, column, value) with one row per input row and numeric column."""
    wide = df.select(*keys, *[number(F.col(c), infinities).alias(c) for c in columns])
    return wide.unpivot(keys, list(columns), "column", "value")


def text_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, value) with values as text."""
    wide = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot(keys, list(columns), "column", "value")


def value_counts(long: DataFrame, keys: list[str], value: str = "value", keep_null: bool = False) -> DataFrame:
    """(keys, value, n): the distinct values of each group with their counts."""
    src = long if keep_null else long.where(F.col(value).isNotNull())
    return src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(
    counts: DataFrame,
    keys: list[str],
    value: str = "value",
    weights: tuple[str, ...] = ("n",),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Adds, per weight ``w``, ``cum_w`` (weight of values <= this one) and ``total_w`` (weight of the group).

    ``counts`` must hold one row per (keys, value). With ``buckets=1`` a plain window is used: right for tables that
    are small by construction, such as one row per period.
    """
    if buckets <= 1:
        run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return counts.select(
            "*",
            *[F.sum(w).over(run).alias(f"cum_{w}") for w in weights],
            *[F.sum(w).over(whole).alias(f"total_{w}") for w in weights],
        )
    placed, offsets = _bucketed(counts, keys, value, weights, buckets)
    run = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return on_keys(placed, offsets, [*keys, "_bucket"]).select(
        *counts.columns,
        *[(F.col(f"_before_{w}") + F.sum(w).over(run)).alias(f"cum_{w}") for w in weights],
        *[f"total_{w}" for w in weights],
    )


def _bucketed(counts, keys, value, weights, buckets) -> tuple[DataFrame, DataFrame]:
    """``counts`` with a bucket number per value, and (keys, bucket) with the weight before and inside the bucket.

    Both results place the values by themselves, so the borders must come out alike each time; see :func:`_borders`.
    """
    totals = counts.groupBy(*keys).agg(*[F.sum(w).alias(f"total_{w}") for w in weights])
    bounds = on_keys(_borders(counts, keys, value, buckets), totals, keys)
    placed = _count_below(on_keys(counts, bounds, keys), value, "_bounds", buckets - 1, "_bucket").drop("_bounds")
    sizes = placed.groupBy(*keys, "_bucket").agg(
        *[F.sum(w).alias(f"_size_{w}") for w in weights], *[F.first(f"total_{w}").alias(f"total_{w}") for w in weights]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket", *[f"total_{w}" for w in weights], *[f"_size_{w}" for w in weights],
        *[F.coalesce(F.sum(f"_size_{w}").over(before), F.lit(0)).alias(f"_before_{w}") for w in weights],
    )
    return placed.drop(*[f"total_{w}" for w in weights]), offsets


def _borders(counts: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """(keys, _bounds): borders between about equal numbers of distinct values; they only balance the work, ranks stay exact.

    They lie at equal steps among the values of smallest hash, so they follow from the values alone. A sketched quantile depends on
    the order in which partial sketches arrive: two branches of a plan would get different borders, and ranks from both would be wrong.
    """
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(value), value)
    drawn = counts.select(*keys, value, F.row_number().over(first).alias("_i")).where(F.col("_i") <= DRAWN)
    ordered = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_drawn"))
    at = [F.get("_drawn", F.ceil(F.size("_drawn") * F.lit(i) / F.lit(buckets)).cast("int") - 1) for i in range(1, buckets)]
    return ordered.select(*keys, F.array(*at).alias("_bounds"))


def _count_below(df: DataFrame, value: str, bounds: str, size: int, name: str) -> DataFrame:
    """Adds how many of the sorted ``bounds`` lie below ``value``: a binary search in a few generated comparisons."""
    df = df.withColumn(name, F.lit(0))
    for step in [1 << i for i in reversed(range(size.bit_length()))]:
        at = F.get(F.col(bounds), F.col(name) + F.lit(step - 1))
        df = df.withColumn(name, F.col(name) + F.when(at < F.col(value), F.lit(step)).otherwise(F.lit(0)))
    return df


def on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on keys that are never NULL; plain equality keeps the partitioning an aggregate on them has left."""
    return left.join(right, keys, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` where NULL keys meet. It needs its own shuffle, so it is kept for keys that can be NULL."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_r_{k}" for k in keys])


def _rank_pick(p: float) -> tuple[Column, Column, Column]:
    pos = F.lit(float(p)) * (F.col("total_n") - 1)
    k = F.floor(pos)
    return pos - k, F.col("cum_n") > k, F.col("cum_n") > k + 1


def quantiles_of(
    counts: DataFrame,
    keys: list[str],
    probs: dict[str, float],
    value: str = "value",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(keys, name...): exact linearly interpolated quantiles, one column per name in ``probs``."""
    if buckets <= 1:
        cum = cumulative_counts(counts, keys, value, buckets=1)
    else:
        placed, offsets = _bucketed(counts, keys, value, ("n",), buckets)
        holds = F.lit(False)
        for p in probs.values():
            k = F.floor(F.lit(float(p)) * (F.col("total_n") - 1))
            end = F.col("_before_n") + F.col("_size_n")
            holds = holds | ((F.col("_before_n") <= k) & (k < end)) | ((F.col("_before_n") <= k + 1) & (k + 1 < end))
        run = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        cum = on_keys(placed, offsets.where(holds), [*keys, "_bucket"]).withColumn(
            "cum_n", F.col("_before_n") + F.sum("n").over(run)
        )
    picks = []
    for name, p in probs.items():
        frac, at_low, at_high = _rank_pick(p)
        picks.append(F.max(frac).alias(f"_f_{name}"))
        picks.append(F.min(F.when(at_low, F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(at_high, F.col(value))).alias(f"_hi_{name}"))
    agg = cum.groupBy(*keys).agg(*picks)
    kind = counts.schema[value].dataType
    exact = isinstance(kind, DecimalType)  # decimals stay decimals; the fraction has nine digits then
    part = lambda n: F.col(f"_f_{n}").cast("decimal(10,9)") if exact else F.col(f"_f_{n}")
    return agg.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + part(n) * (F.coalesce(F.col(f"_hi_{n}"), F.col(f"_lo_{n}")) - F.col(f"_lo_{n}"))
            ).cast(kind if exact else "double").alias(n)
            for n in probs
        ],
    )


def quantiles(
    long: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value", buckets: int = BUCKETS
) -> DataFrame:
    """Exact quantiles of a long table, see :func:`quantiles_of`."""
    return quantiles_of(value_counts(long, keys, value), keys, probs, value, buckets)


def top_values(counts: DataFrame, keys: list[str], k: int, value: str = "value") -> DataFrame:
    """The ``k`` most frequent values of each group with ``rank``; ties by value.

    A rank filter on ``row_number`` is pushed below the shuffle, so each map task sends at most ``k`` rows per group.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last(value))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
