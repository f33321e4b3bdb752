"""Period labels and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("hour", "day", "week", "month", "quarter", "year")


def period_start(ts: Column, period: str) -> Column:
    """First instant of the tumbling window that holds ``ts``."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")
    return F.date_trunc(period, ts)


def period_label(ts: Column, period: str, label: str = "start") -> Column:
    """Window label: its start, or with ``label='end'`` its closing day (Sunday, month end, ...)."""
    start = period_start(ts, period)
    if label == "start" or period in ("hour", "day"):
        return start
    step = {"week": F.expr("interval 7 days"), "month": F.expr("interval 1 month"),
            "quarter": F.expr("interval 3 months"), "year": F.expr("interval 1 year")}[period]
    return start + step - F.expr("interval 1 day")


def day_of_week(d: Column) -> Column:
    """Monday = 0."""
    return F.weekday(d)


def is_month_end(d: Column) -> Column:
    return (F.to_date(d) == F.last_day(d)).cast("int")


def is_quarter_end(d: Column) -> Column:
    return ((F.to_date(d) == F.last_day(d)) & (F.month(d) % 3 == 0)).cast("int")


def season_position(ts: Column, period: int) -> Column:
    """Position of ``ts`` in a season of ``period`` steps: hour, weekday, month, day of month or day of year."""
    if period == 24:
        return F.hour(ts)
    if period == 7:
        return F.weekday(ts)
    if period == 12:
        return F.month(ts) - 1
    if period in (30, 31):
        return F.least(F.dayofmonth(ts) - 1, F.lit(period - 1))
    return F.pmod(F.dayofyear(ts) - 1, F.lit(period))
