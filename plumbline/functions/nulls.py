"""One missing-value model: NaN and, where asked, infinities become NULL on entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def number(c: Column, infinities: bool = False) -> Column:
    """``c`` as double with NaN (and ±Infinity if ``infinities``) turned into NULL."""
    d = c.cast("double")
    bad = F.isnan(d)
    if infinities:
        bad = bad | (F.abs(d) == F.lit(_INF))
    return F.when(~bad, d)


def bounded(c: Column, limit: float = 1e10) -> Column:
    """NULL and NaN become 0, infinities become ±``limit``."""
    d = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(d == F.lit(_INF), F.lit(limit)).when(d == F.lit(-_INF), F.lit(-limit)).otherwise(d)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL where the base is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(flag: Column) -> Column:
    """Aggregate: fraction of rows where ``flag`` holds (NULL counts as no)."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def hits(flag: Column) -> Column:
    """Aggregate: number of rows where ``flag`` holds; 0 on no rows."""
    return F.count_if(flag)
