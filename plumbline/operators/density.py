"""Density scores from tail probabilities, clusters, covariance and distance to the mean.

The tail methods follow the published empirical-distribution (ECOD) and copula (COPOD) detectors. Tail counts are
running counts over distinct values per feature, so rows are never compared with each other; all folds share one pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.nulls import bounded, ratio
from plumbline.operators.counts import BUCKETS, cumulative_counts, on_keys, quantiles
from plumbline.sources.checkpoint import cut

METHODS = ("ecod", "copod")


def fold_of(key: Column, folds: int = 5) -> Column:
    """Fold by key: repeatable whatever the partitioning."""
    return F.pmod(key.cast("bigint"), F.lit(folds)).cast("int")


def _combined(method: str, left: Column, right: Column, skew: Column) -> Column:
    """Outlyingness of one value from its two tails and the sign of the feature's skewness."""
    by_skew = F.when(skew > 0, right).when(skew < 0, left).otherwise(left + right)
    if method == "ecod":
        return F.greatest(left, right, by_skew)
    return F.greatest(by_skew, (left + right) / 2)


def tail_scores(df: DataFrame, keys: list[str], features: list[str], split: str, splits: list[int], method: str | tuple[str, ...] = "ecod",
                buckets: int = BUCKETS) -> DataFrame:
    """(keys, split, score, train_<s>...): tail score per row, and for each ``s`` its score among rows outside split ``s``.

    ``score`` uses the distribution of all rows; ``train_s`` that of the rows with another split, and is NULL inside it.
    Missing values count as 0 and infinities are bounded. Several methods share the tails; their scores over all rows
    then come under the methods' names.
    """
    methods = (method,) if isinstance(method, str) else tuple(method)
    if not set(methods) <= set(METHODS):
        raise ValueError(f"method must be among {METHODS}")
    long = df.select(*keys, split, *[bounded(F.col(f)).alias(f) for f in features]).unpivot(
        [*keys, split], features, "_feature", "_value"
    )
    outside = {s: F.col(split) != s for s in splits}
    weights = ["n"] + [f"n{s}" for s in splits]
    counts = long.groupBy("_feature", "_value").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n{s}") for s, c in outside.items()]
    )
    skews = long.groupBy("_feature").agg(
        F.skewness("_value").alias("s_n"), *[F.skewness(F.when(c, F.col("_value"))).alias(f"s_n{s}") for s, c in outside.items()]
    )
    cum = cumulative_counts(counts, ["_feature"], "_value", tuple(weights), buckets).join(skews, "_feature")
    named = {"score": methods[0]} if len(methods) == 1 else {m: m for m in methods}
    tails = cum.select("_feature", "_value", *[_outlyingness(m, "n").alias(f"o_{c}") for c, m in named.items()],
                       *[_outlyingness(methods[0], f"n{s}").alias(f"o_n{s}") for s in splits])
    rows = on_keys(long, tails, ["_feature", "_value"])
    return rows.groupBy(*keys, split).agg(
        *[F.sum(f"o_{c}").alias(c) for c in named],
        *[F.sum(F.when(outside[s], F.col(f"o_n{s}"))).alias(f"train_{s}") for s in splits],
    )


def _outlyingness(method: str, w: str) -> Column:
    total, upto, here = F.col(f"total_{w}"), F.col(f"cum_{w}"), F.col(w)
    left = -F.ln(F.nullif(ratio(upto, total), F.lit(0.0)))
    right = -F.ln(F.nullif(ratio(total - upto + here, total), F.lit(0.0)))
    return _combined(method, left, right, F.coalesce(F.col(f"s_{w}"), F.lit(0.0)))


def split_thresholds(scores: DataFrame, splits: list[int], contamination: float, buckets: int = BUCKETS) -> DataFrame:
    """(split_no, threshold): (1 - contamination) quantile of the training scores of each split."""
    long = scores.select(*[F.col(f"train_{s}").alias(str(s)) for s in splits]).unpivot([], [str(s) for s in splits], "split_no", "value")
    return quantiles(long, ["split_no"], {"threshold": 1 - contamination}, buckets=buckets).select(
        F.col("split_no").cast("int").alias("split_no"), "threshold"
    )


def out_of_fold(df: DataFrame, key: str, features: list[str], method: str = "ecod", contamination: float = 0.01, folds: int = 5) -> DataFrame:
    """(key, fold, score, threshold, flag): each row against the threshold learned without its fold."""
    src = df.withColumn("fold", fold_of(F.col(key), folds))
    splits = list(range(folds))
    scores = cut(tail_scores(src, [key], features, "fold", splits, method))  # read for the limits and for the flags
    limits = split_thresholds(scores, splits, contamination)
    return scores.join(F.broadcast(limits), F.col("fold") == F.col("split_no")).select(  # one row per fold
        key, "fold", "score", "threshold", (F.col("score") > F.col("threshold")).cast("int").alias("flag")
    )


def ensemble(df: DataFrame, key: str, features: list[str], contamination: float = 0.01, folds: int = 5) -> DataFrame:
    """(key, fold, ecod, copod, score, threshold, flag): both scores min-max scaled inside each fold and averaged."""
    src = df.withColumn("fold", fold_of(F.col(key), folds))
    both = cut(tail_scores(src, [key], features, "fold", [], METHODS))  # read for the edges, the limits and the flags
    edges = both.groupBy("fold").agg(*[f(c).alias(f"{n}_{c}") for c in METHODS for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = both.join(F.broadcast(edges), "fold")  # one row per fold
    norm = [(F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-10)) for c in METHODS]
    scaled = scaled.withColumn("score", (norm[0] + norm[1]) / 2)
    limits = quantiles(scaled.select("fold", F.col("score").alias("value")), ["fold"], {"threshold": 1 - contamination})
    return scaled.join(F.broadcast(limits), "fold").select(  # one row per fold
        key, "fold", "ecod", "copod", "score", "threshold", (F.col("score") > F.col("threshold")).cast("int").alias("flag")
    )


def many_targets(df: DataFrame, key: str, targets: list[str], features: list[str] | None = None, **how) -> DataFrame:
    """(target, key, ...): one run per target column.

    Without ``features`` every target is scored with all other targets as features. That is the same set for each of
    them, so one run serves all.
    """
    if features is None:
        once = out_of_fold(df, key, targets, **how)
        return once.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return reduce(DataFrame.unionByName, [
        out_of_fold(df, key, [*features, t], **how).withColumn("target", F.lit(t)) for t in targets
    ])


def _moments(df: DataFrame, features: list[str], train: Column | None) -> dict[str, tuple[Column, Column]]:
    pick = lambda f: F.when(train, F.col(f).cast("double")) if train is not None else F.col(f).cast("double")
    m = df.agg(F.struct(*[F.struct(F.avg(pick(f)).alias("m"), F.stddev_pop(pick(f)).alias("s")).alias(f) for f in features])).scalar()
    return {f: (m[f]["m"], m[f]["s"]) for f in features}


def mean_distance(df: DataFrame, features: list[str], train: Column | None = None) -> DataFrame:
    """Adds ``score``: mean absolute z-score over the features divided by 10, at most 1."""
    stats = _moments(df, features, train)
    z = [F.abs(F.col(f) - m) / (s + 1e-8) for f, (m, s) in stats.items()]
    return df.withColumn("score", F.least(F.lit(1.0), reduce(lambda a, b: a + b, z) / len(z) / 10))


def z_norm(df: DataFrame, features: list[str], train: Column | None = None, threshold: float = 0.95) -> DataFrame:
    """Adds ``score``: length of the z-vector over the largest one, and ``flag``."""
    stats = _moments(df, features, train)
    z = [((F.col(f) - m) / (s + 1e-8)) ** 2 for f, (m, s) in stats.items()]
    out = df.withColumn("_z", F.sqrt(reduce(lambda a, b: a + b, z)))
    top = out.agg(F.max("_z")).scalar()
    return out.withColumn("score", F.col("_z") / (top + 1e-8)).withColumn("flag", (F.col("score") >= threshold).cast("int")).drop("_z")


def mahalanobis(df: DataFrame, features: list[str], train: Column | None = None) -> DataFrame:
    """Adds ``score``: squared Mahalanobis distance under mean and covariance of the training rows.

    Only means, deviations and the features x features correlation matrix come to the driver.
    """
    base = df.withColumn("_x", F.array(*[bounded(F.col(f)) for f in features]))
    fit = base.where(train) if train is not None else base
    row = fit.agg(*[F.avg(F.get("_x", F.lit(i))).alias(f"m{i}") for i in range(len(features))],
                  *[F.stddev_samp(F.get("_x", F.lit(i))).alias(f"s{i}") for i in range(len(features))]).first()
    mean = np.array([row[f"m{i}"] for i in range(len(features))])
    std = np.array([row[f"s{i}"] for i in range(len(features))])
    corr = Correlation.corr(fit.select(array_to_vector("_x").alias("v")), "v").first()[0].toArray()
    corr = np.where(np.isfinite(corr), corr, np.eye(len(features)))
    inverse = np.linalg.pinv(corr * np.outer(std, std))

    numbers = lambda v: F.array(*[F.lit(float(a)) for a in v])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    gap = F.zip_with("_x", numbers(mean), lambda x, m: x - m)
    rows = F.array(*[numbers(r) for r in inverse])  # features x features
    return base.withColumn("_d", gap).withColumn("score", dot(F.transform(rows, lambda r: dot(r, F.col("_d"))), F.col("_d"))).drop("_x", "_d")


def cluster_scores(df: DataFrame, keys: list[str], features: list[str], clusters: int = 8, contamination: float = 0.05,
                   alpha: float = 0.9, beta: float = 5.0, seed: int = 42) -> DataFrame:
    """(keys, cluster, score, flag): distance to the own centre in large clusters, else to the nearest large one."""
    base = df.select(*keys, F.array(*[bounded(F.col(f)) for f in features]).alias("_x")).withColumn("_v", array_to_vector("_x"))
    model = KMeans(k=clusters, seed=seed, featuresCol="_v", predictionCol="cluster").fit(base)
    sizes = model.summary.clusterSizes
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    large, covered = [], 0
    for pos, i in enumerate(order):
        large.append(i)
        covered += sizes[i]
        drop = pos + 1 < len(order) and sizes[i] / max(sizes[order[pos + 1]], 1) >= beta
        if covered >= alpha * sum(sizes) or drop:
            break
    centres = [model.clusterCenters()[i].tolist() for i in range(len(sizes))]

    def to_centre(c: list[float]) -> Column:
        sq = F.zip_with("_x", F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x))

    nearest = F.least(*[to_centre(centres[i]) for i in large]) if len(large) > 1 else to_centre(centres[large[0]])
    own = reduce(lambda a, i: a.when(F.col("cluster") == i, to_centre(centres[i])), large[1:], F.when(F.col("cluster") == large[0], to_centre(centres[large[0]])))
    scored = model.transform(base).select(*keys, "cluster", own.otherwise(nearest).alias("score"))
    limit = quantiles(scored.select(F.lit(0).alias("_k"), F.col("score").alias("value")), ["_k"], {"t": 1 - contamination}).select("t").scalar()
    return scored.withColumn("flag", (F.col("score") > limit).cast("int"))
