"""Registered queries: a name, an output layout, the Spark plan and, where SQL can say it, the same query in SQL.

A layout such as ``"period:d column:s n:i mean:f"`` fixes names and types on both sides: ``s`` text, ``i`` bigint,
``f`` double rounded to 4 digits, ``g`` double rounded to 2, ``b`` boolean, ``d`` date as text, ``t`` timestamp as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Averages of cents often end exactly half way between two rounded values; both sides are moved off that point before
# rounding, so that the last bit of a floating-point sum does not decide.
NUDGE = 3.3e-7


class Tables:
    """Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    layout: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return shape(self.plan(Tables(spark, folder)), self.layout)

    def oracle(self) -> str | None:
        return None if self.sql is None else shape_sql(self.sql, self.layout)


def _fields(layout: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in layout.split()]


def shape(df: DataFrame, layout: str) -> DataFrame:
    casts = {
        "s": lambda c: c.cast("string"),
        "i": lambda c: c.cast("bigint"),
        "f": lambda c: F.round(c.cast("double") + F.lit(NUDGE), 4) + F.lit(0.0),
        "g": lambda c: F.round(c.cast("double") + F.lit(100 * NUDGE), 2) + F.lit(0.0),
        "b": lambda c: c.cast("boolean"),
        "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
        "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    }
    return df.select(*[casts[t](F.col(f"`{n}`")).alias(n) for n, t in _fields(layout)])


def shape_sql(sql: str, layout: str) -> str:
    casts = {
        "s": "CAST({c} AS VARCHAR)",
        "i": "CAST({c} AS BIGINT)",
        "f": f"round(CAST({{c}} AS DOUBLE) + {NUDGE:.8f}, 4) + 0.0",
        "g": f"round(CAST({{c}} AS DOUBLE) + {100 * NUDGE:.8f}, 2) + 0.0",
        "b": "CAST({c} AS BOOLEAN)",
        "d": "strftime({c}, '%Y-%m-%d')",
        "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
    }
    cols = ", ".join(casts[t].format(c=f'"{n}"') + f' AS "{n}"' for n, t in _fields(layout))
    return f"SELECT {cols} FROM (\n{sql.strip()}\n) AS result"
