"""Profile of tumbling time windows: table, number, category, relation and business metrics.

Tables stay long, one row per (period, column); :func:`to_metrics` gives (period, metric, value) for scoring and
:func:`pivot_metrics` a wide table at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.nulls import number, ratio
from plumbline.operators.counts import (
    on_keys, numeric_long, quantiles_of, text_long, top_values, value_counts,
)
from plumbline.operators.profile_state import PC, Registry, duplicate_rows, numbers_of, texts_of, value_state, with_period
from plumbline.sources.checkpoint import cut
from plumbline.types import columns_by_kind

QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def table_metrics(df: DataFrame, ts: str, period: str = "day", label: str = "start") -> DataFrame:
    """Rows, columns, missing cells and duplicate rows per window; the time column itself is left out."""
    cols = [c for c in df.columns if c != ts]
    missing = _missing(df, cols)
    out = with_period(df, ts, period, label).groupBy("period").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(missing).alias("missing_values_total"),
        F.count_distinct(F.struct(*cols)).alias("_distinct"),
    )
    n = F.col("row_count")
    return out.select(
        "period", "row_count", F.lit(len(cols)).alias("column_count"), "missing_values_total",
        (F.col("missing_values_total") * 100.0 / (n * len(cols))).alias("missing_values_pct"),
        (n - F.col("_distinct")).alias("duplicate_rows"),
        ((n - F.col("_distinct")) * 100.0 / n).alias("duplicate_rows_pct"),
    )


def _missing(df: DataFrame, cols: list[str]) -> Column:
    return sum((F.when(_absent(df, c), 1).otherwise(0) for c in cols), F.lit(0))


def _absent(df: DataFrame, c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c).isNull()


def numeric_metrics(
    df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None, label: str = "start"
) -> DataFrame:
    """One row per (period, column): counts, moments, quantiles, drift against the whole table, outliers, entropy."""
    cols = list(columns or columns_by_kind(df, (ts,)).numeric)
    long = numeric_long(with_period(df, ts, period, label), ["period"], cols)
    return numeric_from_counts(value_counts(long, PC, keep_null=True))


def numeric_from_counts(counts: DataFrame) -> DataFrame:
    """The metrics of :func:`numeric_metrics` from (period, column, value, n), rows without a value included."""
    counts = counts.withColumn(
        "n_all", F.col("n")
    ).withColumn("n", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(F.lit(0)))
    v, w = F.col("value"), F.col("n")
    basics = counts.groupBy(*PC).agg(
        F.sum("n_all").alias("_rows"), F.sum(w).alias("count"),
        F.try_divide(F.sum(v * w), F.sum(w)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).alias("unique_count"),
        F.sum(F.when(v == 0, w).otherwise(F.lit(0))).alias("zero_count"),
        F.sum(F.when(v < 0, w).otherwise(F.lit(0))).alias("negative_count"),
    )
    facts = on_keys(basics, quantiles_of(counts, PC, QUANTILES), PC, "left").withColumn("iqr", F.col("p75") - F.col("p25"))
    facts = _with_overall(_spread(counts, facts))
    n = F.col("count")
    pct = lambda c: ratio(c * 100.0, n)
    drift = lambda a, g: F.when(F.col(g) != 0, (F.col(a) - F.col(g)) / F.col(g)).otherwise(0.0)
    return facts.select(
        *PC, "count",
        (F.col("_rows") - n).alias("missing_count"), ((F.col("_rows") - n) * 100.0 / F.col("_rows")).alias("missing_pct"),
        "mean", "median", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        "p25", "p75", "p95", "p99", "iqr", "skew", "kurt",
        drift("mean", "_gmean").alias("mean_vs_global"), drift("std", "_gstd").alias("std_vs_global"),
        F.when(F.col("_gstd") > 0, (F.col("mean") - F.col("_gmean")) / F.col("_gstd")).otherwise(0.0).alias("zscore"),
        "outliers_count", pct(F.col("outliers_count")).alias("outliers_pct"), "entropy",
        "unique_count", pct(F.col("unique_count")).alias("unique_pct"),
        "zero_count", pct(F.col("zero_count")).alias("zero_pct"),
        "negative_count", pct(F.col("negative_count")).alias("negative_pct"),
        ratio(F.col("std"), F.abs("mean")).alias("cv"),
    )


def auto_bins(n: Column, lo: Column, hi: Column, iqr: Column) -> Column:
    """Histogram bin count: the finer of the Sturges and Freedman-Diaconis rules, 1 without spread."""
    sturges = (hi - lo) / (F.log2(n.cast("double")) + 1)
    fd = 2 * iqr / F.cbrt(n.cast("double"))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    return F.when(hi > lo, F.ceil((hi - lo) / width)).otherwise(F.lit(1)).cast("bigint")


def _spread(counts: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds central moments, outlier count and density entropy, read from the value counts with their facts."""
    carried = [c for c in facts.columns if c not in PC]
    v, lo, hi, w = F.col("value"), F.col("min"), F.col("max"), F.col("n")
    cells = on_keys(counts, facts, PC).withColumn("_bins", auto_bins(F.col("count"), lo, hi, F.col("iqr")))
    cells = cells.withColumn("_bin", stats.equal_width_bin(v, lo, hi, F.col("_bins")))
    outside = (v < F.col("p25") - 1.5 * F.col("iqr")) | (v > F.col("p75") + 1.5 * F.col("iqr"))
    gap = v - F.col("mean")
    bars = cells.groupBy(*PC, "_bin").agg(
        F.sum(w).alias("_n"), F.sum(F.when(outside, w).otherwise(F.lit(0))).alias("_out"),
        *[F.sum(w * F.pow(gap, F.lit(float(k)))).alias(f"_m{k}") for k in (2, 3, 4)],
        F.first(F.when(hi > lo, (hi - lo) / F.col("_bins")).otherwise(F.lit(1.0))).alias("_width"),
        *[F.first(c).alias(c) for c in carried],
    )
    density = F.col("_n") / (F.col("count") * F.col("_width"))
    out = bars.groupBy(*PC).agg(
        F.sum("_out").alias("outliers_count"),
        (-F.sum(F.when(F.col("_n") > 0, density * F.ln(density)))).alias("entropy"),
        *[F.sum(f"_m{k}").alias(f"_m{k}") for k in (2, 3, 4)],
        *[F.first(c).alias(c) for c in carried],
    )
    n = F.col("count").cast("double")
    spread = F.col("max") > F.col("min")
    m2 = F.col("_m2") / n
    g1 = F.col("_m3") / n / F.pow(m2, F.lit(1.5))
    g2 = F.col("_m4") / n / (m2 * m2) - 3
    return out.select(
        *PC, *carried, "outliers_count", "entropy",
        F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))).alias("std"),
        F.when((n > 2) & spread, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when((n > 3) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurt"),
    )


def _with_overall(facts: DataFrame) -> DataFrame:
    """Mean and deviation of the whole column, merged from the windows (one row per window, so the frames are small)."""
    whole = Window.partitionBy("column")
    n = F.col("count")
    mean = F.try_divide(F.sum(n * F.col("mean")).over(whole), F.sum(n).over(whole))
    out = facts.withColumn("_gmean", mean)
    inner = F.coalesce((n - 1) * F.col("std") * F.col("std"), F.lit(0.0)) + n * F.pow(F.col("mean") - F.col("_gmean"), F.lit(2.0))
    total = F.sum(n).over(whole)
    return out.withColumn("_gstd", F.when(total > 1, F.sqrt(F.sum(inner).over(whole) / (total - 1))))


def velocity(
    df: DataFrame, ts: str, columns: list[str], key: str, period: str = "day", label: str = "start"
) -> DataFrame:
    """(period, column, velocity): last minus first value of the window over its value count; ``key`` breaks ties."""
    picks = [F.struct(F.lit(c).alias("column"), _velocity(c, ts, key).alias("velocity")) for c in columns]
    out = with_period(df, ts, period, label).groupBy("period").agg(F.array(*picks).alias("_v"))
    return out.select("period", F.inline("_v"))


def _velocity(c: str, ts: str, key: str) -> Column:
    v = number(F.col(c))
    at = F.when(v.isNotNull(), F.struct(F.col(ts), F.col(key)))
    return F.when(F.count(v) > 1, (F.max_by(v, at) - F.min_by(v, at)) / F.count(v))


def category_metrics(
    df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None, label: str = "start"
) -> DataFrame:
    """One row per (period, column): counts, most common value, entropy (natural logarithm)."""
    return category_from_counts(_category_counts(df, ts, period, columns, label))


def category_from_counts(counts: DataFrame) -> DataFrame:
    """The metrics of :func:`category_metrics` from (period, column, value, n), rows without a value included."""
    present = F.when(F.col("value").isNotNull(), F.col("n"))
    facts = counts.groupBy(*PC).agg(
        F.sum("n").alias("_rows"), F.coalesce(F.sum(present), F.lit(0)).alias("count"),
        F.count("value").alias("unique_count"),
        stats.entropy_from_counts(present).alias("entropy"),
    )
    best = top_values(counts.where(F.col("value").isNotNull()), PC, 1).select(
        *PC, F.col("value").alias("most_common"), F.col("n").alias("most_common_count")
    )
    n = F.col("count")
    return on_keys(facts, best, PC, "left").select(
        *PC, "count", (F.col("_rows") - n).alias("missing_count"),
        ((F.col("_rows") - n) * 100.0 / F.col("_rows")).alias("missing_pct"),
        "unique_count", ratio(F.col("unique_count") * 100.0, n).alias("unique_pct"),
        "most_common", "most_common_count", ratio(F.col("most_common_count") * 100.0, n).alias("most_common_pct"),
        "entropy",
    )


def _category_counts(df, ts, period, columns, label) -> DataFrame:
    cols = list(columns or columns_by_kind(df, (ts,)).categorical)
    return value_counts(text_long(with_period(df, ts, period, label), ["period"], cols), PC, keep_null=True)


def top_categories(
    df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None, k: int = 5, label: str = "start"
) -> DataFrame:
    """(period, column, rank, category, pct): the ``k`` most frequent values with their share of non-null rows."""
    counts = _category_counts(df, ts, period, columns, label).where(F.col("value").isNotNull())
    totals = counts.groupBy(*PC).agg(F.sum("n").alias("_total"))
    return on_keys(top_values(counts, PC, k), totals, PC).select(
        *PC, "rank", F.col("value").alias("category"), (F.col("n") * 100.0 / F.col("_total")).alias("pct")
    )


def pivot_top(top: DataFrame, k: int = 5) -> DataFrame:
    """One row per (period, column) with ``top1_category, top1_pct, ...``."""
    return top.groupBy(*PC).pivot("rank", list(range(1, k + 1))).agg(
        F.first("category").alias("category"), F.first("pct").alias("pct")
    ).select(*PC, *[F.col(f"{i}_{m}").alias(f"top{i}_{m}") for i in range(1, k + 1) for m in ("category", "pct")])


def correlation_metrics(
    df: DataFrame, ts: str, columns: list[str], period: str = "day", label: str = "start"
) -> DataFrame:
    """(period, metric, value): Pearson correlation of each column pair and their mean absolute value."""
    aggs, names = _correlations(columns)
    wide = _with_mean_correlation(with_period(df, ts, period, label).groupBy("period").agg(*aggs), names)
    return wide.unpivot(["period"], [*names, "avg_abs_correlation"], "metric", "value")


def _correlations(columns: list[str]) -> tuple[list[Column], list[str]]:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    names = [f"corr_{a}_{b}" for a, b in pairs]
    return [stats.correlation(number(F.col(a)), number(F.col(b))).alias(n) for (a, b), n in zip(pairs, names)], names


def _with_mean_correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    known = F.array_compact(F.array(*[F.abs(F.col(c)) for c in names]))
    mean_abs = ratio(F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x), F.size(known))
    return wide.withColumn("avg_abs_correlation", mean_abs)


def business_metrics(
    df: DataFrame, ts: str, groups: dict[str, list[str]], period: str = "day", per_column: bool = False,
    label: str = "start",
) -> DataFrame:
    """(period, metric, value): totals, averages and ratios of sums for named column groups.

    ``per_column=True`` gives ``total_{group}_{column}`` and ``avg_{group}_{column}`` instead of group totals.
    """
    wide = with_period(df, ts, period, label).groupBy("period").agg(*_business(groups, df.columns, per_column))
    return wide.unpivot(["period"], wide.columns[1:], "metric", "value")


def _business(groups: dict[str, list[str]], known: list[str], per_column: bool = False) -> list[Column]:
    aggs: list[Column] = []
    for g, cols in groups.items():
        cols = [c for c in cols if c in known]
        num = {c: number(F.col(c)) for c in cols}
        if per_column:
            for c in cols:
                aggs += [F.coalesce(F.sum(num[c]), F.lit(0.0)).alias(f"total_{g}_{c}"), F.avg(num[c]).alias(f"avg_{g}_{c}")]
            continue
        if not cols:
            continue
        sums = {c: F.coalesce(F.sum(num[c]), F.lit(0.0)) for c in cols}
        total = sums[cols[0]]
        for c in cols[1:]:
            total = total + sums[c]
        aggs.append(total.alias(f"total_{g}"))
        aggs += [F.avg(num[c]).alias(f"avg_{c}_{g}") for c in cols]
        aggs += [ratio(sums[a], sums[b]).alias(f"ratio_{a}_{b}_{g}") for i, a in enumerate(cols) for b in cols[i + 1:]]
    return aggs


LIGHT_METRICS = ("count", "mean", "std", "min", "max", "p25", "p75", "mean_vs_global", "zscore", "outliers_pct")


def light_metrics(df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None) -> DataFrame:
    """The short list of number metrics."""
    return numeric_metrics(df, ts, period, columns).select(*PC, *LIGHT_METRICS)


def to_metrics(per_column: DataFrame) -> DataFrame:
    """(period, metric, value) from one row per (period, column); text metrics are left out."""
    kinds = columns_by_kind(per_column, ("period", "column"))
    wide = per_column.select(*PC, *[F.col(c).cast("double").alias(c) for c in kinds.numeric])
    long = wide.unpivot(PC, list(kinds.numeric), "_m", "value")
    return long.select("period", F.concat_ws("_", "column", "_m").alias("metric"), "value")


def table_to_metrics(table: DataFrame) -> DataFrame:
    """(period, metric, value) from one row per period."""
    cols = [c for c in table.columns if c != "period"]
    return table.select("period", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["period"], cols, "metric", "value"
    )


def period_profile(
    df: DataFrame, ts: str, period: str = "day", correlation: list[str] | None = None,
    business: dict[str, list[str]] | None = None, rate: list[str] | None = None, skip: tuple[str, ...] = (),
    key: str | None = None, label: str = "start", extra: Registry | None = None,
) -> DataFrame:
    """(period, metric, value): every window metric of the table, and the metrics of the registry ``extra``.

    The table is read twice: once for the distinct values of its columns and its distinct rows, from which all metrics of single columns
    and the duplicates follow, and once for what needs whole rows (missing cells, correlations, totals, rates).
    """
    use = df.drop(*skip)
    kinds = columns_by_kind(use, (ts,))
    names = [c for c in use.columns if c != ts]
    state = cut(value_state(use, ts, period, list(kinds.numeric), list(kinds.categorical), label, names))
    numbers, texts = numbers_of(state, list(kinds.numeric)), texts_of(state, list(kinds.categorical))
    aggs, pairs = _correlations(correlation or [])
    aggs += _business(business or {}, df.columns)
    aggs += [_velocity(c, ts, key or df.columns[0]).alias(f"{c}_velocity") for c in rate or []]
    n = F.count(F.lit(1))
    rows = with_period(df, ts, period, label).groupBy("period").agg(
        F.lit(len(names)).alias("column_count"), F.sum(_missing(use, names)).alias("missing_values_total"),
        (F.sum(_missing(use, names)) * 100.0 / (n * len(names))).alias("missing_values_pct"), *aggs)
    rows = _with_mean_correlation(rows, pairs) if pairs else rows
    out = table_to_metrics(rows).unionByName(table_to_metrics(duplicate_rows(state)))
    for kind, counts, columns, finish in (("numeric", numbers, kinds.numeric, numeric_from_counts), ("text", texts, kinds.categorical, category_from_counts)):
        if columns:
            out = out.unionByName(to_metrics(finish(counts)))
            if extra and extra.names(kind):
                out = out.unionByName(to_metrics(extra.of(counts, PC, kind)))
    return out


def registered_metrics(df: DataFrame, ts: str, extra: Registry, period: str = "day", skip: tuple[str, ...] = (), label: str = "start") -> DataFrame:
    """(period, metric, value): only the metrics of the registry, as :func:`period_profile` gives them; each column is read once."""
    use = df.drop(*skip)
    kinds = columns_by_kind(use, (ts,))
    out = None
    for kind, numeric, texts in (("numeric", list(kinds.numeric), []), ("text", [], list(kinds.categorical))):
        if (numeric or texts) and extra.names(kind):
            state = value_state(use, ts, period, numeric, texts, label)
            counts = numbers_of(state, numeric) if numeric else texts_of(state, texts)
            part = to_metrics(extra.of(counts, PC, kind))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no registered metric fits a column of the table")
    return out


def pivot_metrics(metrics: DataFrame, names: list[str], period: str = "period") -> DataFrame:
    """One row per period with one column per metric name."""
    return metrics.where(F.col("metric").isin(*names)).groupBy(period).pivot("metric", names).agg(F.first("value"))
