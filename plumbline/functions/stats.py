"""Statistics Spark has no single function for, as aggregates or scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import ratio


def skew(v: Column) -> Column:
    """Aggregate: sample skewness with bias correction; NULL below three values or without spread."""
    n = F.count(v).cast("double")
    return F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(v: Column) -> Column:
    """Aggregate: excess kurtosis with bias correction; NULL below four values or without spread."""
    n = F.count(v).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NULL without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def entropy_from_counts(n: Column, base: str = "e") -> Column:
    """Aggregate over value counts: ``log N - sum(n log n) / N``, which needs no second pass for ``N``."""
    log = F.log2 if base == "2" else F.ln
    total = F.sum(n).cast("double")
    return log(total) - F.sum(n * log(n.cast("double"))) / total


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: Column | int) -> Column:
    """0-based bin of ``v`` in ``bins`` equal bins on [lo, hi]; the last bin is closed on both sides.

    Without spread the range is [lo - 0.5, lo + 0.5], so every value falls in the middle bin.
    """
    k = F.lit(bins) if isinstance(bins, int) else bins
    inside = F.least(F.floor((v - lo) * k / F.nullif(hi - lo, F.lit(0.0))), k.cast("bigint") - 1)
    return F.when(hi > lo, inside).otherwise(F.floor(k * F.lit(0.5))).cast("bigint")


def right_closed_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based bin of ``v`` in ``bins`` equal intervals that are open on the left; the lowest value is in bin 1."""
    width = F.nullif((hi - lo) / F.lit(float(bins)), F.lit(0.0))
    edge = F.greatest(F.ceil((v - lo) / width), F.lit(1))
    return F.when(hi > lo, F.least(edge, F.lit(bins))).otherwise(F.lit(bins // 2)).cast("bigint")
