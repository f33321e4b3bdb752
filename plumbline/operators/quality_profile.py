"""Quality profile per day (or other period) and column: basics, distribution, quantiles, entropy, relations.

:func:`quality_metrics` reads the table twice: value counts of single columns, and counts of binned pairs with the correlations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.nulls import number, ratio
from plumbline.operators.counts import on_keys, numeric_long, quantiles_of, text_long, value_counts
from plumbline.operators.joins import checked_broadcast
from plumbline.operators.profile_state import PC, Registry, numbers_of, texts_of, value_state, with_period
from plumbline.sources.checkpoint import cut
from plumbline.types import columns_by_kind, quality_type_label

HISTOGRAM_BINS = 10
ENTROPY_BINS = 50
QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


def _long(df: DataFrame, ts: str, period: str, columns) -> tuple[DataFrame, list[str]]:
    cols = list(columns or columns_by_kind(df, (ts,)).numeric)
    return numeric_long(with_period(df, ts, period), ["period"], cols), cols


def basic_metrics(df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None) -> DataFrame:
    """Mean, Minimum, Maximum, StandardDeviation, Sum, count, Completeness, missingCount, Size, zero and negative shares."""
    long, cols = _long(df, ts, period, columns)
    v = F.col("value")
    out = long.groupBy(*PC).agg(
        F.avg(v).alias("Mean"), F.min(v).alias("Minimum"), F.max(v).alias("Maximum"),
        F.stddev_samp(v).alias("StandardDeviation"), F.coalesce(F.sum(v), F.lit(0.0)).alias("Sum"),
        F.count(F.lit(1)).alias("count"), F.count(v).alias("_present"),
        F.count_if(v == 0).alias("zeroCount"), F.count_if(v < 0).alias("negativeCount"),
    )
    types = F.create_map(*[F.lit(x) for c in cols for x in (c, quality_type_label(df.schema[c].dataType))])
    return _basics(out).withColumn("DataType", F.element_at(types, F.col("column")))


def basics_from_counts(counts: DataFrame) -> DataFrame:
    """The numbers of :func:`basic_metrics` from (period, column, value, n), rows without a value included."""
    v, n = F.col("value"), F.col("n")
    seen = F.when(v.isNotNull(), n)
    none = lambda c: F.coalesce(c, F.lit(0))
    out = counts.groupBy(*PC).agg(
        F.try_divide(F.sum(v * n), F.sum(seen)).alias("Mean"), F.min(v).alias("Minimum"), F.max(v).alias("Maximum"),
        F.coalesce(F.sum(v * n), F.lit(0.0)).alias("Sum"), F.sum(n).alias("count"), none(F.sum(seen)).alias("_present"),
        none(F.sum(F.when(v == 0, n))).alias("zeroCount"), none(F.sum(F.when(v < 0, n))).alias("negativeCount"),
    )
    gaps = on_keys(counts, out.select(*PC, "Mean", "_present"), PC).groupBy(*PC).agg(F.sum(n * F.pow(v - F.col("Mean"), F.lit(2.0))).alias("_m2"))
    out = on_keys(out, gaps, PC)
    return _basics(out.withColumn("StandardDeviation", F.when(F.col("_present") > 1, F.sqrt(F.col("_m2") / (F.col("_present") - 1)))))


def _basics(out: DataFrame) -> DataFrame:
    present = F.col("_present")
    pct = lambda c: F.coalesce(ratio(F.col(c) * 100.0, present), F.lit(0.0))
    return out.select(
        *PC, "Mean", "Minimum", "Maximum", "StandardDeviation", "Sum", "count",
        ratio(present, F.col("count")).alias("Completeness"), (F.col("count") - present).alias("missingCount"),
        "zeroCount", pct("zeroCount").alias("zeroCountPercentage"),
        "negativeCount", pct("negativeCount").alias("negativeCountPercentage"),
        F.col("count").alias("Size"), F.lit(0).alias("MinLength"), F.lit(0).alias("MaxLength"),
    )


def text_lengths(df: DataFrame, ts: str, columns: list[str], period: str = "day") -> DataFrame:
    """Size, MinLength, MaxLength of text columns."""
    long = text_long(with_period(df, ts, period), ["period"], columns)
    return long.groupBy(*PC).agg(
        F.count(F.lit(1)).alias("Size"), F.min(F.length("value")).alias("MinLength"), F.max(F.length("value")).alias("MaxLength")
    )


def _counts_with_range(df, ts, period, columns) -> DataFrame:
    long, _ = _long(df, ts, period, columns)
    return _with_range(value_counts(long, PC))


def _with_range(counts: DataFrame) -> DataFrame:
    edges = counts.groupBy(*PC).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("present")
    )
    return on_keys(counts, edges, PC)


def distribution_metrics(df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None) -> DataFrame:
    """CountDistinct and its ratio under three names, Histogram (10 counts), Entropy (base 2, at most 50 bins)."""
    return _distribution(_counts_with_range(df, ts, period, columns))


def _distribution(cells: DataFrame) -> DataFrame:
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    fine = F.least(F.lit(ENTROPY_BINS), F.col("distinct"))
    cells = cells.withColumn("_wide", stats.equal_width_bin(v, lo, hi, HISTOGRAM_BINS)).withColumn(
        "_fine", stats.equal_width_bin(v, lo, hi, fine)
    )
    carried = [F.first("distinct").alias("distinct"), F.first("present").alias("present")]
    bars = cells.groupBy(*PC, "_fine", "_wide").agg(F.sum("n").alias("n"), *carried)
    wide = bars.groupBy(*PC, "_wide").agg(F.sum("n").alias("n"))
    histogram = wide.groupBy(*PC).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("_wide") == i, F.col("n"))), F.lit(0)) for i in range(HISTOGRAM_BINS)]).alias("counts")
    )
    narrow = bars.groupBy(*PC, "_fine").agg(F.sum("n").alias("n"), F.first("distinct").alias("distinct"), F.first("present").alias("present"))
    entropy = narrow.groupBy(*PC).agg(
        stats.entropy_from_counts(F.col("n"), "2").alias("Entropy"),
        F.first("distinct").alias("CountDistinct"), F.first("present").alias("_present"),
    )
    share = ratio(F.col("CountDistinct"), F.col("_present"))
    return on_keys(entropy, histogram, PC).select(
        *PC, "CountDistinct", share.alias("Uniqueness"), share.alias("UniqueValueRatio"), share.alias("Distinctness"),
        "Entropy", "counts", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("Histogram"),
    )


def histogram_features(df: DataFrame, counts: str = "Histogram") -> DataFrame:
    """hist_mean, hist_std (population), hist_sum, hist_max, hist_entropy (base 2) from comma-joined counts."""
    arr = F.when(F.col(counts).isNotNull(), F.transform(F.split(counts, ","), lambda x: x.try_cast("double"))).otherwise(
        F.array(F.lit(0.0))
    )
    out = df.withColumn("_h", arr)
    total = F.aggregate("_h", F.lit(0.0), lambda a, x: a + x)
    size = F.size("_h").cast("double")
    out = out.withColumn("hist_sum", total).withColumn("hist_mean", F.col("hist_sum") / size)
    square = F.aggregate("_h", F.lit(0.0), lambda a, x: a + (x - F.col("hist_mean")) * (x - F.col("hist_mean")))
    plogp = F.aggregate(
        "_h", F.lit(0.0),
        lambda a, x: a + F.try_divide(x, F.col("hist_sum")) * F.log2(F.try_divide(x, F.col("hist_sum")) + F.lit(1e-12)),
    )
    return (
        out.withColumn("hist_std", F.sqrt(square / size)).withColumn("hist_max", F.array_max("_h"))
        .withColumn("hist_entropy", F.when(F.col("hist_sum") > 0, -plogp).otherwise(F.lit(0.0))).drop("_h")
    )


def quantile_metrics(
    df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """ApproxQuantiles_0.1 ... 0.9: exact (the name is historic), or sketched with ``approx``. Empty groups give 0."""
    long, _ = _long(df, ts, period, columns)
    groups = long.groupBy(*PC)
    if approx:
        q = F.percentile_approx("value", list(QUANTILES.values()), 10000)
        out = groups.agg(q.alias("_q")).select(*PC, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)])
    else:
        out = _exact_quantiles(value_counts(long, PC, keep_null=True))
    return _named_quantiles(out)


def _exact_quantiles(counts: DataFrame) -> DataFrame:
    counts = counts.withColumn("n", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(F.lit(0)))
    return on_keys(counts.select(*PC).distinct(), quantiles_of(counts, PC, QUANTILES), PC, "left")


def _named_quantiles(out: DataFrame) -> DataFrame:
    return out.select(*PC, *[F.coalesce(n, F.lit(0.0)).alias(f"ApproxQuantiles_{p}") for n, p in QUANTILES.items()])


def correlations(df: DataFrame, ts: str, columns: list[str], period: str = "day", first: int = 5) -> DataFrame:
    """(period, column, other, correlation): every column against the first ``first`` columns."""
    base = with_period(df, ts, period).select("period", *[number(F.col(c)).alias(c) for c in columns])
    return base.groupBy("period").agg(F.array(*_correlation_items(columns, first)).alias("_c")).select("period", F.inline("_c"))


def _correlation_items(columns: list[str], first: int = 5, of=F.col) -> list[Column]:
    """Aggregates: a struct (column, other, correlation) per pair; ``of`` gives the values of a column."""
    done: dict[tuple, Column] = {}
    items = []
    for c, o in [(c, o) for c in columns for o in columns[:first] if c != o]:
        key = tuple(sorted((c, o)))
        done.setdefault(key, stats.correlation(of(key[0]), of(key[1])))
        items.append(F.struct(F.lit(c).alias("column"), F.lit(o).alias("other"), done[key].alias("correlation")))
    return items


def mutual_information(df: DataFrame, ts: str, columns: list[str], period: str = "day", bins: int = 10) -> DataFrame:
    """(period, column, MutualInformation) of each later column with the first one, over ``bins`` right-closed bins.

    Only rows where both values are present count. The joint table has at most ``bins``² cells per (period, column).
    """
    first, rest = columns[0], columns[1:]
    base = with_period(df, ts, period).select("period", *[number(F.col(c)).alias(c) for c in columns])
    pairs = base.unpivot(["period", first], rest, "column", "y").withColumnRenamed(first, "x").where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    edges = pairs.groupBy(*PC).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    binned = on_keys(pairs, edges, PC).select(
        *PC, *[stats.right_closed_bin(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins).alias(f"b{c}") for c in "xy"]
    )
    return _information(binned.groupBy(*PC, "bx", "by").agg(F.count(F.lit(1)).alias("n")))


def _information(joint: DataFrame) -> DataFrame:
    """(period, column, MutualInformation) from the joint table (period, column, bx, by, n)."""
    xs = joint.groupBy(*PC, "bx").agg(F.sum("n").alias("nx"))
    ys = joint.groupBy(*PC, "by").agg(F.sum("n").alias("ny"))
    totals = joint.groupBy(*PC).agg(F.sum("n").alias("total"))
    full = on_keys(on_keys(on_keys(joint, xs, [*PC, "bx"]), ys, [*PC, "by"]), totals, PC)
    n, total = F.col("n"), F.col("total")
    return full.groupBy(*PC).agg(F.sum(n / total * F.log2(n * total / (F.col("nx") * F.col("ny")))).alias("MutualInformation"))


def dataset_metrics(df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(period, total_records, dataset_completeness) over the profiled columns; ``limit`` keeps the first periods."""
    cols = list(columns or columns_by_kind(df, (ts,)).numeric)
    filled = sum((F.when(number(F.col(c)).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    out = with_period(df, ts, period).groupBy("period").agg(
        F.count(F.lit(1)).alias("total_records"), (F.sum(filled) / (F.count(F.lit(1)) * len(cols))).alias("dataset_completeness")
    )
    return out.orderBy("period").limit(limit) if limit else out


def _related(df: DataFrame, ts: str, period: str, cols: list[str], state: DataFrame, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Mutual information and correlations from one read: rows become counts of binned pairs, and one more cell per period carries the correlations.

    Bin borders come from the state: extremes of both columns over the rows where both are present.
    """
    v = F.when(F.col("n_both") > 0, F.col("value"))
    edges = state.where(F.col("column").isin(*cols[1:])).groupBy(*PC).agg(
        F.min("lo_first").alias("lo_x"), F.max("hi_first").alias("hi_x"), F.min(v).alias("lo_y"), F.max(v).alias("hi_y"))
    by_period = edges.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lo_x", "hi_x", "lo_y", "hi_y")))).alias("_edges"))  # one entry per column
    base = with_period(df, ts, period).select("period", *[number(F.col(f"`{c}`")).alias(c) for c in cols])
    rows = base.join(checked_broadcast(by_period), "period", "left")
    x = F.col(f"`{cols[0]}`")

    def cell(c: str) -> Column:
        e, y = F.element_at("_edges", F.lit(c)), F.col(f"`{c}`")
        both = x.isNotNull() & y.isNotNull()
        return F.struct(F.lit(c).alias("column"), F.when(both, stats.right_closed_bin(x, e["lo_x"], e["hi_x"], bins)).alias("bx"),
                        F.when(both, stats.right_closed_bin(y, e["lo_y"], e["hi_y"], bins)).alias("by"))

    whole = F.struct(F.lit("").alias("column"), F.lit(None).cast("bigint").alias("bx"), F.lit(None).cast("bigint").alias("by"))
    cells = F.filter(F.array(whole, *[cell(c) for c in cols[1:]]), lambda s: s["bx"].isNotNull() | (s["column"] == ""))
    long = rows.select("period", *[F.col(f"`{c}`").alias(f"_v_{i}") for i, c in enumerate(cols)], F.inline(cells))
    at = {c: F.when(F.col("column") == "", F.col(f"_v_{i}")) for i, c in enumerate(cols)}
    joint = cut(long.groupBy(*PC, "bx", "by").agg(F.count(F.lit(1)).alias("n"), F.array(*_correlation_items(cols, of=at.get)).alias("_c")))
    pairs = joint.where("column = ''").select("period", F.inline("_c"))
    return _information(joint.where("column <> ''").select(*PC, "bx", "by", "n")), pairs


def quality_metrics(df: DataFrame, ts: str, period: str = "day", columns: list[str] | None = None, texts: list[str] | None = None,
                    extra: Registry | None = None) -> DataFrame:
    """(period, column, metric, value): the whole quality profile in long form, numbers only.

    Basics, distribution, quantiles, mutual information, correlations (``Correlation_<other>``), lengths of text columns, and
    ``total_records`` and ``dataset_completeness`` under the column ``dataset``; ``extra`` adds own metrics. The table is read twice.
    """
    kinds = columns_by_kind(df, (ts,))
    cols, words = list(kinds.numeric if columns is None else columns), list(kinds.categorical if texts is None else texts)
    state = cut(value_state(df, ts, period, cols, words, first=cols[0] if cols else None))
    numbers, strings = numbers_of(state, cols), texts_of(state, words)
    parts = []
    if cols:
        parts += [basics_from_counts(numbers), _distribution(_with_range(numbers.where(F.col("value").isNotNull()))), _named_quantiles(_exact_quantiles(numbers))]
        seen = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
        total = F.sum(F.when(F.col("column") == cols[0], F.col("n")).otherwise(0))
        parts.append(numbers.groupBy("period").agg(F.lit("dataset").alias("column"), total.alias("total_records"), ratio(seen, F.sum("n")).alias("dataset_completeness")))
    if len(cols) > 1:
        information, pairs = _related(df, ts, period, cols, state)
        parts.append(information)
    if words:
        parts.append(strings.groupBy(*PC).agg(F.sum("n").alias("Size"), F.min(F.length("value")).alias("MinLength"), F.max(F.length("value")).alias("MaxLength")))
    for kind, counts, names in (("numeric", numbers, cols), ("text", strings, words)):
        if names and extra and extra.names(kind):
            parts.append(extra.of(counts, PC, kind))
    out = None
    for p in parts:
        names = list(columns_by_kind(p, tuple(PC)).numeric)
        long = p.select(*PC, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(PC, [F.col(f"`{c}`") for c in names], "metric", "value")
        out = long if out is None else out.unionByName(long)
    if len(cols) > 1:
        out = out.unionByName(pairs.select(*PC, F.concat(F.lit("Correlation_"), "other").alias("metric"), F.col("correlation").alias("value")))
    return out
