"""Whole detections: period metrics to graded alerts, entity panels to consensus rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.nulls import number, ratio
from plumbline.operators import cleaning, counts, density, explain, fusion, layers, panel, quality_profile, rolling, selection, sequence
from plumbline.sources.checkpoint import cut
from plumbline.types import columns_by_kind


@dataclass(frozen=True)
class DetectionConfig:
    """Settings of :func:`detect_periods`."""

    length: int = 14
    percentile: float = 0.95
    contamination: float = 0.02
    method: str = "ecod"
    density_limit: float | None = None
    sequence_limit: float = fusion.SEQUENCE_LIMIT
    consensus_limit: float = fusion.CONSENSUS_LIMIT
    dates: tuple[str, ...] = ()
    latest: int = 7


def standardise(metrics: DataFrame) -> DataFrame:
    """Values per metric with mean 0 and population deviation 1; missing is 0, flat metrics are 0."""
    whole = Window.partitionBy("metric")
    v = F.coalesce("value", F.lit(0.0))
    rows = metrics.withColumn("value", v)
    return rows.withColumns({"_m": F.avg("value").over(whole), "_s": F.stddev_pop("value").over(whole)}).select(
        "period", "metric", F.coalesce(ratio(F.col("value") - F.col("_m"), F.nullif("_s", F.lit(0.0))), F.lit(0.0)).alias("value")
    )


def detect_periods(metrics: DataFrame, config: DetectionConfig = DetectionConfig(), targets: list[str] | None = None) -> DataFrame:
    """(period, is_target, scores, flags, severity) from a (period, metric, value) table.

    Periods are scored by prediction error and by tails of the distribution, both learned without the target dates.
    """
    chosen = cleaning.target_metrics(metrics, targets).drop("target")
    # scaled once: the last bit of a mean depends on the order in which rows arrive, and tails are joined to rows by their exact values
    scaled = cleaning.mark_targets(cut(standardise(chosen)), "period", list(config.dates) or None, config.latest)
    seq = sequence.sequence_scores(scaled.drop("is_target"), scaled.where(~F.col("is_target")).drop("is_target"), config.length, config.percentile)
    tails = density_of_metrics(scaled.withColumn("split", F.col("is_target").cast("int")), config.method)
    limit = config.density_limit
    if limit is None:
        train = tails.where(F.col("train").isNotNull()).select(F.lit(0).alias("_k"), F.col("train").alias("value"))
        limit = counts.quantiles(train, ["_k"], {"t": 1 - config.contamination}, buckets=1).select("t").scalar()
    out = fusion.consensus(seq, tails, ["period"], limit, config.sequence_limit, config.consensus_limit)
    marks = tails.select("period", F.col("split").cast("boolean").alias("is_target"))
    return fusion.severity(out).join(marks, "period")


def quality_features(df: DataFrame, ts: str, period: str, columns: list[str], windows: tuple[int, ...] = (7,), lags: tuple[int, ...] = (1,),
                     variance: float = selection.VARIANCE, threshold: float = selection.CORRELATION) -> DataFrame:
    """(period, metric, value): quality metrics of a raw table with rolling and lag features, thinned out by variance and correlation."""
    profile = quality_profile.quality_metrics(df, ts, period, columns)
    base = cut(profile.select("period", F.concat_ws("_", "column", "metric").alias("metric"), "value"))
    features = cut(rolling.feature_table(base, windows, lags))
    varied = cut(features.join(selection.variance_filter(features, variance).where("keep").select("metric"), "metric", "left_semi"))
    kept = selection.correlation_filter(varied, threshold=threshold).where("keep").select("metric")
    return features.join(kept, "metric", "left_semi")


def quality_pipeline(df: DataFrame, ts: str, period: str, columns: list[str], config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """From raw rows to explanations: quality profile, features, selection, detection, and why each flagged period stands out."""
    features = cut(quality_features(df, ts, period, columns))
    flagged = cut(detect_periods(features, config).where("consensus_anomaly").select("period", F.col("severity").alias("overall_severity"), "consensus_score"))
    top = explain.top_metrics(explain.contributions(explain.history_facts(features, flagged)))
    return explain.explanations(top, tuple(columns)).join(flagged, "period")


def density_of_metrics(scaled: DataFrame, method: str = "ecod") -> DataFrame:
    """(period, split, score, train): tail scores of a long table, where each metric is one feature.

    ``scaled`` is read several times and joined on its values, so give a table that is cut.
    """
    inside = F.col("split") != 1
    vc = scaled.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n1"))
    skews = scaled.groupBy("metric").agg(F.skewness("value").alias("s_n"), F.skewness(F.when(inside, F.col("value"))).alias("s_n1"))
    cum = counts.cumulative_counts(vc, ["metric"], "value", ("n", "n1"), buckets=1).join(skews, "metric")
    tails = cum.select("metric", "value", density._outlyingness(method, "n").alias("_o"), density._outlyingness(method, "n1").alias("_t"))
    return scaled.join(tails, ["metric", "value"]).groupBy("period", "split").agg(
        F.sum("_o").alias("score"), F.sum(F.when(inside, F.col("_t"))).alias("train")
    )


def detect_panel(df: DataFrame, entity: str, ts: str, key: str, value: str, min_days: int = 20, contamination: float = 0.01) -> DataFrame:
    """(entity, day, value, first_score, second_score): days of entities that two detectors agree on.

    The panel is filled, cut to entities with enough observed days and brought to one mean value per entity and day. The
    first detector is the distance to the previous days of the entity, the second the tail score over all entities.
    """
    kept = panel.keep_long_series(df, entity, ts, min_days)
    filled = panel.gap_fill(kept, entity, ts, [value], key)
    days = cut(filled.groupBy(entity, "day").agg(F.avg(value).alias("value")))  # read by both detectors and for their limits
    by_layer = layers.statistical_layer(layers.enough_rows(days, [entity], min_days), [entity], "day", window=7, sigma=2.0)
    past = Window.partitionBy(entity).orderBy("day").rowsBetween(-7, -1)
    moved = by_layer.withColumn("score", F.coalesce(F.abs(F.col("value") - F.avg("value").over(past)), F.lit(0.0)))
    first = moved.select(entity, "day", "score", F.col("statistical_anomaly").cast("int").alias("flag"))
    ident = days.withColumn("fold", density.fold_of(F.datediff("day", F.lit("1970-01-01").cast("date"))))
    splits = list(range(5))
    tails = cut(density.tail_scores(ident, [entity, "day"], ["value"], "fold", splits))
    limits = density.split_thresholds(tails, splits, contamination)
    second = tails.join(F.broadcast(limits), F.col("fold") == F.col("split_no")).select(  # one row per fold
        entity, "day", "score", (F.col("score") > F.col("threshold")).cast("int").alias("flag"))
    return fusion.consensus_rows(days, first, second, [entity, "day"], ["value"])


@dataclass(frozen=True)
class GroupFindings:
    """What :func:`detect_groups` found.

    ``flags``: (group, column, day, value, statistical, seasonal, sequence, any_anomaly). ``results``: one row per group and target
    column with row_count, day_count, anomaly_count, first_anomaly, last_anomaly, error. ``summary``: (fact, name, n).
    """

    flags: DataFrame
    results: DataFrame
    summary: DataFrame


def detect_groups(df: DataFrame, group: list[str], ts: str, columns: list[str], least: int = 30, window: int = 20, periods: tuple[int, ...] = (7,), length: int = 14,
                  sigma: float = 3.0) -> GroupFindings:
    """Layered detection for every group and every target column in one plan keyed by (group, column).

    Groups need ``least`` rows; rows without a time or with a null group key belong to none. Values are brought to one mean per day, so a
    frame holds the days of a series, however many rows a group has. A target that cannot be analysed (no such column, no numbers, no values)
    gives an error in its rows of the result and does not touch the others.
    """
    kinds = columns_by_kind(df)
    good = [c for c in columns if c in kinds.numeric]
    error = {c: "no column of this name" if c not in df.columns else f"not a number column: {df.schema[c].dataType.simpleString()}" for c in columns if c not in good}
    rows = df.where(F.col(ts).isNotNull())
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    sizes = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") >= least))
    keys = [*group, "column"]
    wanted = sizes.select(*group, "row_count", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(error.get(c)).cast("string").alias("_bad")) for c in columns])))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(F.col(c)).alias("_v")) for c in good]) if good else F.expr("cast(array() as array<struct<column:string,_v:double>>)")
    daily = rows.select(*group, F.to_date(ts).alias("day"), F.inline(cells)).groupBy(*keys, "day").agg(F.avg("_v").alias("value"))
    days = cut(counts.on_keys(daily.where(F.col("value").isNotNull()), sizes.select(*group), group, "left_semi"))  # every layer reads it
    past = Window.partitionBy(*keys).orderBy("day").rowsBetween(-length, -1)
    guess = days.withColumns({"_n": F.count("value").over(past), "error": F.abs(F.col("value") - F.avg("value").over(past))}).where(F.col("_n") == length).drop("_n")
    marks = layers.all_layers(layers.statistical_layer(days, keys, "day", window=window, sigma=sigma), layers.seasonal_layer(days, keys, "day", periods=periods, sigma=sigma),
                              layers.error_layer(guess, keys, sigma=sigma), [*keys, "day"])
    flags = cut(counts.on_keys(days, marks, [*keys, "day"]))
    hit = F.when(F.col("any_anomaly"), F.col("day"))
    found = flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("day_count"), F.count(hit).alias("anomaly_count"), F.min(hit).alias("first_anomaly"), F.max(hit).alias("last_anomaly"))
    none = F.lit(0).cast("bigint")
    results = wanted.join(found, keys, "left").select(
        *keys, "row_count", F.coalesce("day_count", none).alias("day_count"), F.when(F.col("_bad").isNull(), F.coalesce("anomaly_count", none)).alias("anomaly_count"),
        "first_anomaly", "last_anomaly", F.coalesce("_bad", F.when(F.col("day_count").isNull(), F.lit("no values"))).alias("error"))
    results = cut(results)
    by_group = results.groupBy(*group).agg(F.coalesce(F.sum("anomaly_count"), none).alias("n"))
    label = F.concat_ws("_", *[F.col(g).cast("string") for g in group])
    fact = lambda name: F.lit(name).alias("fact")
    totals = by_group.agg(F.count(F.lit(1)).alias("total_groups"), F.count_if(F.col("n") > 0).alias("groups_with_anomalies"), F.coalesce(F.sum("n"), none).alias("total_anomalies"))
    summary = totals.unpivot([], totals.columns, "fact", "n").select("fact", F.lit("").alias("name"), "n")
    summary = summary.union(results.where(F.col("error").isNull()).groupBy("column").agg(F.sum("anomaly_count").alias("n")).select(fact("anomalies_by_column"), "column", "n"))
    return GroupFindings(flags, results, summary.union(by_group.select(fact("anomalies_by_group"), label, "n")))
