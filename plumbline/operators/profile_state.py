"""State of a profile and the registry of metrics that are finished from it.

A table is read once and becomes (period, column, value, category, n): the distinct values of every column with their counts, and
the distinct rows as the column without a name. Every per-column metric follows from this state, the built-in ones as well as those
of a user, so that own metrics cost no further read.

A :class:`Metric` is a partial state (aggregates over value and count), a way to merge partial states, and a final expression. States
of single periods can therefore be stored and merged over longer spans without reading rows again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.calendar import period_label
from plumbline.functions.nulls import number, ratio

PC = ["period", "column"]
ROWS = ""  # the column of the state that holds the distinct rows


def with_period(df: DataFrame, ts: str, period: str, label: str = "start") -> DataFrame:
    """Adds ``period``; rows without a time belong to no window and are left out."""
    return df.where(F.col(ts).isNotNull()).withColumn("period", period_label(F.col(ts).cast("timestamp"), period, label))


def row_name(columns: list[str]) -> Column:
    """96 bits of hash over a row; null cells count, wherever they are."""
    cells = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.concat_ws(":", F.xxhash64(*cells), F.hash(*cells))


def value_state(df: DataFrame, ts: str, period: str, numeric: list[str], texts: list[str] = [], label: str = "start", rows_of: list[str] = [],  # noqa: B006
                first: str | None = None) -> DataFrame:
    """(period, column, value, category, n) of number and text columns; ``rows_of`` adds the distinct rows over these columns.

    With ``first`` each value also tells on how many rows ``first`` is present (``n_both``) and its extremes there (``lo_first``, ``hi_first``).
    """
    none = {"value": F.lit(None).cast("double"), "category": F.lit(None).cast("string")}
    entry = lambda name, **cells: F.struct(F.lit(name).alias("column"), *[(cells.get(k, v)).alias(k) for k, v in none.items()])
    entries = [entry(c, value=number(F.col(f"`{c}`"))) for c in numeric] + [entry(c, category=F.col(f"`{c}`").cast("string")) for c in texts]
    if rows_of:
        entries.append(entry(ROWS, category=row_name(rows_of)))
    other = [number(F.col(f"`{first}`")).alias("_first")] if first else []
    long = with_period(df, ts, period, label).select("period", *other, F.inline(F.array(*entries)))
    sums = [F.count(F.lit(1)).alias("n")]
    if first:
        x = F.when(F.col("value").isNotNull(), F.col("_first"))
        sums += [F.count(x).alias("n_both"), F.min(x).alias("lo_first"), F.max(x).alias("hi_first")]
    return long.groupBy(*PC, "value", "category").agg(*sums)


def numbers_of(state: DataFrame, columns: list[str]) -> DataFrame:
    """(period, column, value, n) of the number columns, with the rows without a value."""
    return state.where(F.col("column").isin(*columns)).select(*PC, "value", "n")


def texts_of(state: DataFrame, columns: list[str]) -> DataFrame:
    """(period, column, value, n) of the text columns, with the rows without a value."""
    return state.where(F.col("column").isin(*columns)).select(*PC, F.col("category").alias("value"), "n")


def duplicate_rows(state: DataFrame) -> DataFrame:
    """(period, row_count, duplicate_rows, duplicate_rows_pct) from the distinct rows of the state."""
    n = F.sum("n")
    extra = n - F.count(F.lit(1))
    return state.where(F.col("column") == ROWS).groupBy("period").agg(n.alias("row_count"), extra.alias("duplicate_rows"), (extra * 100.0 / n).alias("duplicate_rows_pct"))


@dataclass(frozen=True)
class Metric:
    """A metric of one column.

    ``parts`` are named aggregates over (value, count), ``final`` makes the number from their results, and ``merge`` tells how a part
    of several states becomes one (a sum, if not given). ``kind`` is the kind of column: numeric or text. Rows without a value
    come with a null value.
    """

    parts: dict[str, Callable[[Column, Column], Column]]
    final: Callable[[dict[str, Column]], Column]
    merge: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    kind: str = "numeric"


class Registry:
    """Metrics by name."""

    def __init__(self, metrics: dict[str, Metric] | None = None):
        self._metrics: dict[str, Metric] = {}
        for name, m in (metrics or {}).items():
            self.register(name, m)

    def register(self, name: str, metric: Metric) -> None:
        if name in self._metrics:
            raise ValueError(f"metric {name} is registered twice")
        if metric.kind not in ("numeric", "text"):
            raise ValueError("kind must be 'numeric' or 'text'")
        self._metrics[name] = metric

    def names(self, kind: str | None = None) -> list[str]:
        return [n for n, m in self._metrics.items() if kind in (None, m.kind)]

    def _columns(self, kind: str):
        return [(n, self._metrics[n], {p: f"{n}__{p}" for p in self._metrics[n].parts}) for n in self.names(kind)]

    def partial(self, counts: DataFrame, keys: list[str], kind: str = "numeric") -> DataFrame:
        """keys and one column per part, from (keys, value, n)."""
        v, n = F.col("value"), F.col("n")
        return counts.groupBy(*keys).agg(*[m.parts[p](v, n).alias(c) for _, m, cols in self._columns(kind) for p, c in cols.items()])

    def merged(self, partials: DataFrame, keys: list[str], kind: str = "numeric") -> DataFrame:
        """The same columns for coarser keys."""
        return partials.groupBy(*keys).agg(*[m.merge.get(p, F.sum)(F.col(c)).alias(c) for _, m, cols in self._columns(kind) for p, c in cols.items()])

    def finished(self, partials: DataFrame, keys: list[str], kind: str = "numeric") -> DataFrame:
        """keys and one column per metric."""
        return partials.select(*keys, *[m.final({p: F.col(c) for p, c in cols.items()}).alias(n) for n, m, cols in self._columns(kind)])

    def of(self, counts: DataFrame, keys: list[str], kind: str = "numeric") -> DataFrame:
        """keys and one column per metric, from (keys, value, n)."""
        return self.finished(self.partial(counts, keys, kind), keys, kind)


def weighted(use: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Aggregate: sum of ``use(value)`` over all rows; rows where it is null count 0."""
    return lambda v, n: F.coalesce(F.sum(use(v) * n), F.lit(0.0))


def rows_where(cond: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Aggregate: number of rows for which the condition on the value holds."""
    return lambda v, n: F.coalesce(F.sum(F.when(cond(v), n)), F.lit(0))


def share_where(cond: Callable[[Column], Column], kind: str = "numeric") -> Metric:
    """Share of the present values for which the condition holds."""
    return Metric({"hits": rows_where(cond), "present": rows_where(lambda v: v.isNotNull())}, lambda p: ratio(p["hits"], p["present"]), kind=kind)


def mean_of(use: Callable[[Column], Column], kind: str = "numeric") -> Metric:
    """Mean of an expression over the rows where it is not null."""
    return Metric({"sum": weighted(use), "present": rows_where(lambda v: use(v).isNotNull())}, lambda p: ratio(p["sum"], p["present"]), kind=kind)
