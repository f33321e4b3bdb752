"""Local outlier factor with exact nearest neighbours, without comparing all pairs.

Points are cut in halves again and again, one feature after the other, until no part holds more than a fixed number of
places. A part follows the density of the points, so dense regions get small parts and sparse ones large parts. The k-th distance inside its own part bounds the
distance of a point's k-th neighbour; the point is then handed down the same cuts to every part its bound reaches, and
compared there. Points at one place are one place with its smallest keys, so repeated points cost nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.nulls import bounded
from plumbline.sources.checkpoint import cut

LEAF = 128


def _distance(names: list[str], a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(F.col(a + n) - F.col(b + n)) * (F.col(a + n) - F.col(b + n)) for n in names]))


def places(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """(a0, a1, ..., keys, place): distinct points with their k + 1 smallest keys; ``place`` is the smallest."""
    names = [f"a{i}" for i in range(len(features))]
    pts = df.select(F.col(key).alias("_key"), *[(bounded(F.col(f)) + 0.0).alias(n) for n, f in zip(names, features)])
    first = pts.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_key"))).where(F.col("_r") <= k + 1)
    return first.groupBy(*names).agg(F.array_sort(F.collect_list("_key")).alias("keys")).withColumn("place", F.get("keys", F.lit(0)))


def parts(pts: DataFrame, dims: int, leaf: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """The places with their part, and the cuts (part, feature, border) of every round.

    The cut goes at the middle value, or right below it where too few places lie above (a feature capped at its maximum). A part
    is not cut along a feature where neither leaves ``least`` places on both sides.
    """
    now = cut(pts.withColumn("part", F.lit(0).cast("bigint")))
    rounds, idle, turn = [], 0, 0
    while idle < dims:
        x = F.col(f"a{turn % dims}")
        full = now.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(x, 0.5).alias("_middle")).where(F.col("_n") > leaf)
        middle = F.col("_middle")
        sides = now.join(full, "part").groupBy("part", middle).agg(
            F.count_if(x < middle).alias("_below"), F.count_if(x > middle).alias("_above"), F.count(F.lit(1)).alias("_n"), F.max(F.when(x < middle, x)).alias("_lower"))
        # ties with the middle go to either side: below it or above it must lie enough places for a cut
        border = F.when((F.col("_above") >= least) & (F.col("_n") - F.col("_above") >= least), middle).when(
            (F.col("_below") >= least) & (F.col("_n") - F.col("_below") >= least), F.col("_lower"))
        cuts = cut(sides.select("part", border.alias("border"), F.lit(turn % dims).alias("feature")).where(F.col("border").isNotNull()))
        turn += 1
        if cuts.isEmpty():
            idle += 1
            continue
        idle = 0
        rounds.append(cuts)
        half = F.when(x > F.col("border"), 1).otherwise(0)
        now = cut(now.join(cuts.drop("feature"), "part", "left").withColumn(
            "part", F.when(F.col("border").isNull(), F.col("part") * 2).otherwise(F.col("part") * 2 + half)).drop("border"))
    return now, rounds


def comparisons(df: DataFrame, key: str, features: list[str], k: int = 20, leaf: int = LEAF) -> DataFrame:
    """One row per pair of places that are compared: those in a part and the places whose bound reaches it."""
    names = [str(i) for i in range(len(features))]
    now, rounds = parts(places(df, key, features, k), len(names), max(leaf, 2 * (k + 1)), k + 1)
    other = now.select("part", *[F.col(f"a{n}").alias(f"b{n}") for n in names], F.col("keys").alias("other_keys"), F.col("place").alias("other_place"))
    inside = now.join(other, "part").select("place", "other_place", F.size("other_keys").alias("n"), _distance(names, "a", "b").alias("d"))
    run = Window.partitionBy("place").orderBy("d", "other_place").rowsBetween(Window.unboundedPreceding, 0)
    # the place itself counts with its keys, of which one is the asking point
    bound = inside.withColumn("_c", F.sum("n").over(run)).groupBy("place").agg(F.min(F.when(F.col("_c") >= k + 1, F.col("d"))).alias("reach"))
    asking = now.join(bound, "place").select(
        "place", *[f"a{n}" for n in names], (F.coalesce("reach", F.lit(float("inf"))) * (1 + 1e-9)).alias("reach"), F.lit(0).cast("bigint").alias("part"))
    for cuts in rounds:
        met = asking.join(cuts, "part", "left")
        low = reduce(lambda out, n: out.when(F.col("feature") == int(n), F.col(f"a{n}")), names, F.when(F.lit(False), F.lit(0.0)))
        halves = F.when(F.col("border").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.array(
            F.when(low - F.col("reach") <= F.col("border"), 0), F.when(low + F.col("reach") > F.col("border"), 1)), lambda h: h.isNotNull()))
        asking = met.withColumn("_half", F.explode(halves)).withColumn("part", F.col("part") * 2 + F.col("_half")).drop("border", "feature", "_half")
    return asking.join(other, "part").withColumn("distance", _distance(names, "a", "b"))


def nearest(df: DataFrame, key: str, features: list[str], k: int = 20, leaf: int = LEAF) -> DataFrame:
    """(key, other, distance, rank): the exact k nearest other points; ties by key."""
    names = [f"a{i}" for i in range(len(features))]
    near = comparisons(df, key, features, k, leaf).where(F.col("distance") <= F.col("reach")).select("place", "distance", F.explode("other_keys").alias("other"))
    best = Window.partitionBy("place").orderBy("distance", "other")
    lists = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).groupBy("place").agg(
        F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("_near"))  # k + 1 entries
    # every point takes its place's list without itself
    pts = df.select(F.col(key), *[(bounded(F.col(f)) + 0.0).alias(n) for n, f in zip(names, features)])
    at = pts.join(places(df, key, features, k).select(*names, "place"), names).select(key, "place")
    own = at.join(lists, "place").withColumn("_near", F.slice(F.filter("_near", lambda s: s["other"] != F.col(key)), 1, k))
    return own.select(key, F.posexplode("_near").alias("_i", "_s")).select(
        key, F.col("_s.other").alias("other"), F.col("_s.distance").alias("distance"), (F.col("_i") + 1).alias("rank"))


def local_outlier_factor(df: DataFrame, key: str, features: list[str], k: int = 20) -> DataFrame:
    """(key, score): mean local density of the neighbours over the own one; about 1 inside a cluster, larger outside."""
    nn = cut(nearest(df, key, features, k))
    kth = nn.groupBy(F.col(key).alias("other")).agg(F.max("distance").alias("_ok"))
    reach = nn.join(kth, "other").withColumn("_reach", F.greatest("distance", "_ok"))
    density = reach.groupBy(key).agg((1 / (F.avg("_reach") + 1e-10)).alias("_lrd"))
    other = density.select(F.col(key).alias("other"), F.col("_lrd").alias("_olrd"))
    return nn.join(other, "other").groupBy(key).agg(F.avg("_olrd").alias("_m")).join(density, key).select(
        key, (F.col("_m") / F.col("_lrd")).alias("score")
    )
