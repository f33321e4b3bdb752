"""Joins on equal keys: denormalising, attaching profiles, aligning category counts, new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.counts import null_safe_join
from plumbline.sources.checkpoint import cut

BROADCAST_ROWS = 100_000


def checked_broadcast(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side``, computed once and marked for broadcast if it has at most so many rows; else the join shuffles."""
    side = cut(side)
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side



def left_with_suffix(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join; right columns whose name the left side already has get ``suffix``."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), keys, "left")


def keep_keys(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur in ``keys_of``."""
    return df.join(keys_of, keys, "left_semi")


def align_counts(a: DataFrame, b: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """(keys, n_a, n_b): both count tables over the union of their keys, 0 where one has none. NULL is a key."""
    left = a.select(*keys, F.col(count).alias("n_a"), F.lit(0).cast("bigint").alias("n_b"))
    right = b.select(*keys, F.lit(0).cast("bigint").alias("n_a"), F.col(count).alias("n_b"))
    return left.unionByName(right).groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def new_keys(current: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``current`` that ``history`` lacks."""
    return null_safe_join(current.select(*keys).distinct(), history.select(*keys), keys, "left_anti")
