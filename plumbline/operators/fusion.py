"""Fusing detector results by key: union, intersection, weighted mean, consensus, severity, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.nulls import ratio
from plumbline.operators.counts import quantiles

# Weights and limits of the consensus of a sequence score and a density score.
SEQUENCE_WEIGHT, DENSITY_WEIGHT = 0.6, 0.4
SEQUENCE_LIMIT, DENSITY_LIMIT, CONSENSUS_LIMIT = 1.0, 0.7, 0.75
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys flagged by either detector."""
    return a.where("flag = 1").select(*keys).union(b.where("flag = 1").select(*keys)).distinct()


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys flagged by both detectors."""
    return a.where("flag = 1").select(*keys).intersect(b.where("flag = 1").select(*keys))


def consensus_rows(rows: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows flagged by both detectors with both scores."""
    x = a.where("flag = 1").select(*keys, F.col("score").alias("first_score"))
    y = b.where("flag = 1").select(*keys, F.col("score").alias("second_score"))
    return rows.select(*keys, *values).join(x, keys).join(y, keys)


def weighted(a: DataFrame, b: DataFrame, keys: list[str], contamination: float = 0.01, buckets: int = 64) -> DataFrame:
    """(keys, score, threshold, flag): both scores min-max scaled over the common keys, averaged; the top share is flagged."""
    both = a.select(*keys, F.col("score").alias("_a")).join(b.select(*keys, F.col("score").alias("_b")), keys)
    e = both.agg(F.struct(*[f(c).alias(n + c) for c in ("_a", "_b") for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    norm = [(F.col(c) - e["lo" + c]) / (e["hi" + c] - e["lo" + c] + 1e-10) for c in ("_a", "_b")]
    scored = both.select(*keys, ((norm[0] + norm[1]) / 2).alias("score"))
    limit = quantiles(scored.select(F.lit(0).alias("_k"), F.col("score").alias("value")), ["_k"], {"t": 1 - contamination}, buckets=buckets)
    out = scored.withColumn("threshold", limit.select("t").scalar())
    return out.withColumn("flag", (F.col("score") > F.col("threshold")).cast("int"))


def consensus(sequence: DataFrame, density: DataFrame, keys: list[str], density_limit: float | Column = DENSITY_LIMIT,
              sequence_limit: float = SEQUENCE_LIMIT, consensus_limit: float = CONSENSUS_LIMIT,
              weights: tuple[float, float] = (SEQUENCE_WEIGHT, DENSITY_WEIGHT)) -> DataFrame:
    """(keys, sequence_score, density_score, consensus_score, four flags) over the keys both detectors scored."""
    s = sequence.select(*keys, F.col("score").alias("sequence_score"))
    d = density.select(*keys, F.col("score").alias("density_score"))
    limit = F.lit(density_limit) if not isinstance(density_limit, Column) else density_limit
    score = weights[0] * F.col("sequence_score") + weights[1] * F.col("density_score")
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = s.join(d, keys).withColumn("consensus_score", score).withColumns({
        "sequence_anomaly": flag(F.col("sequence_score") >= sequence_limit), "density_anomaly": flag(F.col("density_score") >= limit),
        "consensus_anomaly": flag(F.col("consensus_score") >= consensus_limit),
    })
    return out.withColumn("combined_anomaly", F.col("sequence_anomaly") | F.col("density_anomaly"))


def severity(scored: DataFrame) -> DataFrame:
    """Adds ``severity`` for consensus anomalies."""
    level = (
        F.when((F.col("sequence_score") >= 1.5) & (F.col("density_score") >= 0.8), "CRITICAL")
        .when(F.col("consensus_score") >= 0.8, "HIGH").when(F.col("consensus_score") >= 0.6, "MEDIUM").otherwise("LOW")
    )
    return scored.withColumn("severity", F.when(F.col("consensus_anomaly"), level))


def score_statistics(scored: DataFrame, scores: list[str]) -> DataFrame:
    """(score, min, max, mean, std) with the population deviation."""
    items = [F.struct(F.lit(c).alias("score"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
                      F.stddev_pop(c).alias("std")) for c in scores]
    return scored.agg(F.array(*items).alias("_s")).select(F.inline("_s"))


def severity_summary(graded: DataFrame) -> DataFrame:
    """One row: rows, anomalies, rate and counts per severity."""
    n = F.count_if(F.col("consensus_anomaly"))
    return graded.agg(
        F.count(F.lit(1)).alias("rows"), n.alias("total_anomalies"), F.coalesce(ratio(n, F.count(F.lit(1))), F.lit(0.0)).alias("anomaly_rate"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in SEVERITIES],
    )


def group_summary(flagged: DataFrame, group: str, column: str = "column", flag: str = "flag") -> DataFrame:
    """(level, name, groups, groups_with_anomalies, anomalies): overall, per column and per group.

    One pass over the flags by (group, column); the levels come from that small table.
    """
    cells = flagged.groupBy(F.col(group).cast("string").alias("_g"), F.col(column).alias("_c")).agg(F.sum(flag).alias("_a"))
    per_group = cells.groupBy("_g").agg(F.sum("_a").alias("anomalies"))
    overall = per_group.agg(F.lit("total").alias("level"), F.lit(None).cast("string").alias("name"), F.count(F.lit(1)).alias("groups"),
                            F.count_if(F.col("anomalies") > 0).alias("groups_with_anomalies"), F.sum("anomalies").alias("anomalies"))
    columns = cells.groupBy("_c").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_a") > 0).alias("groups_with_anomalies"), F.sum("_a").alias("anomalies"))
    columns = columns.select(F.lit("column").alias("level"), F.col("_c").alias("name"), "groups", "groups_with_anomalies", "anomalies")
    groups = per_group.select(F.lit("group").alias("level"), F.col("_g").alias("name"), F.lit(1).cast("bigint").alias("groups"),
                              F.when(F.col("anomalies") > 0, 1).otherwise(0).cast("bigint").alias("groups_with_anomalies"), "anomalies")
    return overall.unionByName(columns).unionByName(groups)


def top_groups(summary: DataFrame, k: int = 10) -> DataFrame:
    """The groups with most anomalies."""
    return summary.where("level = 'group'").orderBy(F.desc("anomalies"), "name").limit(k).select("name", "anomalies")
