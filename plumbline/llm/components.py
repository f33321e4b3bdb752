"""Connected components by alternating star operations: each round is two joins, no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are hung on the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return hung.union(least.select("b", F.col("m").alias("a"))).filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of the links (a, b) the smallest node of its component. Self links count for nothing."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    while True:
        edges = written(_small_star(_large_star(edges).distinct()))
        # with a fixpoint the edges are stars: their number and sum stay
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
