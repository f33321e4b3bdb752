"""Profile of each date against the rows before it: numeric drift, category drift, new categories.

History means the last N rows before a date, in (date, key) order. Only the newest rows of each date can matter, so the
table is first cut to that many rows per date; a rank filter does this below the shuffle. Rows without a date are left
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.functions.nulls import number, ratio
from plumbline.operators.counts import on_keys, numeric_long, quantiles_of, text_long, top_values, value_counts
from plumbline.operators.joins import checked_broadcast
from plumbline.operators.period_profile import PC

WINDOWS = (7, 14, 30, 90)
EPS = 1e-8
TINY = 1e-10


def _dated(df: DataFrame, date: str) -> DataFrame:
    return df.where(F.col(date).isNotNull()).withColumn("period", F.to_date(date))


def numeric_by_date(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """mean, median, std, min, max, range, iqr, skew, kurtosis, zeros_pct, nulls_pct per (period, column)."""
    long = numeric_long(_dated(df, date), ["period"], columns, infinities=True)
    v = F.col("value")
    rows = F.count(F.lit(1)).cast("double")
    facts = long.groupBy(*PC).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        stats.skew(v).alias("skew"), stats.kurtosis(v).alias("kurtosis"),
        (F.count_if(v == 0) / rows * 100).alias("zeros_pct"), (F.count_if(v.isNull()) / rows * 100).alias("nulls_pct"),
    )
    q = quantiles_of(value_counts(long, PC), PC, {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    return on_keys(facts, q, PC, "left").select(
        *PC, "mean", "median", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        (F.col("_q3") - F.col("_q1")).alias("iqr"), "skew", "kurtosis", "zeros_pct", "nulls_pct",
    )


def past_rows(df: DataFrame, date: str, key: str, columns: list[str], most: int) -> DataFrame:
    """(period, age, columns...): for each date the ``most`` rows before it, the newest with age 0.

    Rows are cut to the newest ``most`` of each date and numbered through by date totals, so no window spans all dates
    but the one over one row per date. Date and numbers then meet by an equality join.
    """
    rows = df.where(F.col(date).isNotNull()).select(F.to_date(date).alias("_day"), F.col(date).alias("_t"), F.col(key).alias("_k"), *columns)
    newest = Window.partitionBy("_day").orderBy(F.desc("_t"), F.desc("_k"))
    tails = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most)
    by_date = Window.partitionBy("_one").orderBy("_day")
    dates = rows.groupBy("_day").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("_n")).withColumn("_one", F.lit(1))
    dates = dates.withColumn("_end", F.sum("_n").over(by_date)).drop("_one")
    numbered = tails.join(dates, "_day").withColumn("_no", F.col("_end") - F.col("_r") + 1).drop("_day", "_t", "_k", "_r", "_n", "_end")
    ages = F.sequence(F.lit(0), F.least(F.lit(most), F.col("_end") - F.col("_n")).cast("int") - 1)
    wanted = dates.where(F.col("_end") > F.col("_n")).select(F.col("_day").alias("period"), (F.col("_end") - F.col("_n")).alias("_before"), F.explode(ages).alias("age"))
    wanted = wanted.withColumn("_no", F.col("_before") - F.col("age")).drop("_before")
    return wanted.join(numbered, "_no").drop("_no")


def numeric_history(df: DataFrame, date: str, key: str, columns: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(period, column, window, mean_diff, median_diff, std_ratio, range_ratio, zscore): date against its last N rows."""
    past = past_rows(df, date, key, columns, max(windows))
    long = past.select("period", "age", *[number(F.col(c), True).alias(c) for c in columns]).unpivot(["period", "age"], columns, "column", "value")
    sized = []
    for n in windows:
        inside = F.col("age") < n
        v = F.when(inside, F.col("value"))
        sized.append(F.struct(
            F.lit(n).alias("window"), F.count_if(inside).alias("have"), F.avg(v).alias("hmean"), F.percentile(v, 0.5).alias("hmedian"),
            F.stddev_samp(v).alias("hstd"), (F.max(v) - F.min(v)).alias("hrange"),
        ))
    facts = long.groupBy(*PC).agg(F.array(*sized).alias("_h")).select(*PC, F.inline("_h")).where(F.col("have") == F.col("window"))
    now = numeric_by_date(df, date, columns)
    at_least = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(EPS)))
    return on_keys(facts, now.select(*PC, "mean", "median", "std", "range"), PC).select(
        *PC, "window", (F.col("mean") - F.col("hmean")).alias("mean_diff"), (F.col("median") - F.col("hmedian")).alias("median_diff"),
        (F.col("std") / at_least(F.col("hstd"))).alias("std_ratio"), (F.col("range") / at_least(F.col("hrange"))).alias("range_ratio"),
        ((F.col("mean") - F.col("hmean")) / at_least(F.col("hstd"))).alias("zscore"),
    )


def numeric_history_days(df: DataFrame, date: str, columns: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The same against the last N calendar days, from mergeable day sums; without the median."""
    long = numeric_long(_dated(df, date), ["period"], columns, infinities=True)
    v = F.col("value")
    day = long.groupBy(*PC).agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"),
                                F.min(v).alias("lo"), F.max(v).alias("hi"))
    day = day.withColumn("_no", F.datediff("period", F.lit("1970-01-01").cast("date")))
    items = []
    for n in windows:
        f = Window.partitionBy("column").orderBy("_no").rangeBetween(-n, -1)
        total = F.sum("n").over(f)
        mean = F.try_divide(F.sum(F.col("n") * F.col("m")).over(f), total)
        square = F.sum(F.coalesce((F.col("n") - 1) * F.col("s") * F.col("s"), F.lit(0.0)) + F.col("n") * F.col("m") * F.col("m")).over(f)
        items.append(F.struct(F.lit(n).alias("window"), mean.alias("hmean"),
                              F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), (square - total * mean * mean) / (total - 1)))).alias("hstd"),
                              (F.max("hi").over(f) - F.min("lo").over(f)).alias("hrange")))
    out = day.withColumn("_h", F.array(*items)).select(*PC, "m", "s", (F.col("hi") - F.col("lo")).alias("_range"), F.inline("_h"))
    at_least = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(EPS)))
    return out.where(F.col("hmean").isNotNull()).select(
        *PC, "window", (F.col("m") - F.col("hmean")).alias("mean_diff"), (F.col("s") / at_least(F.col("hstd"))).alias("std_ratio"),
        (F.col("_range") / at_least(F.col("hrange"))).alias("range_ratio"),
        ((F.col("m") - F.col("hmean")) / at_least(F.col("hstd"))).alias("zscore"),
    )


def category_by_date(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """unique_count, mode (lowest on ties), entropy (base 2, NULL is a category), nulls_pct per (period, column)."""
    counts = _date_counts(df, date, columns)
    totals = counts.groupBy(*PC).agg(
        F.sum("n").alias("_total"), F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("_nulls"),
    )
    p = F.col("n") / F.col("_total")
    entropy = on_keys(counts, totals, PC).groupBy(*PC).agg((-F.sum(p * F.log2(p + TINY))).alias("entropy"))
    best = top_values(counts.where(F.col("value").isNotNull()), PC, 1).select(*PC, F.col("value").alias("mode"))
    return on_keys(on_keys(totals, entropy, PC), best, PC, "left").select(
        *PC, "unique_count", "mode", "entropy", (F.col("_nulls") * 100.0 / F.col("_total")).alias("nulls_pct")
    )


def _date_counts(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    return value_counts(text_long(_dated(df, date), ["period"], columns), PC, keep_null=True)


def divergence_term(p: Column, q: Column) -> Column:
    """One category's part of the Jensen-Shannon divergence (base 2, with 1e-10 guards)."""
    m = 0.5 * (p + q) + TINY
    return 0.5 * (p * F.log2(p / m + TINY) + q * F.log2(q / m + TINY))


def category_history(df: DataFrame, date: str, key: str, columns: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(period, column, window, unique_diff, js_distance, new_categories): date against its last N rows."""
    past = past_rows(df, date, key, columns, max(windows))
    long = past.select("period", "age", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["period", "age"], columns, "column", "value")
    sized = long.withColumn("window", F.explode(F.array(*[F.lit(n) for n in windows]))).where(F.col("age") < F.col("window"))
    keys = [*PC, "window"]
    before = sized.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    full = before.groupBy(*keys).agg(F.sum("n").alias("_rows")).where(F.col("_rows") == F.col("window")).select(*keys)
    before = on_keys(before, full, keys)
    counts = _date_counts(df, date, columns)
    today = on_keys(counts, full, PC).select(*keys, "value", "n")
    zero = F.lit(0).cast("bigint")
    both = today.select(*keys, "value", F.col("n").alias("a"), zero.alias("b")).unionByName(
        before.select(*keys, "value", zero.alias("a"), F.col("n").alias("b"))
    ).groupBy(*keys, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = counts.groupBy(*PC).agg(F.sum("n").alias("_total"))
    both = on_keys(both, totals, PC)
    p, q = ratio(F.col("a"), F.col("_total")), F.col("b") / F.col("window")
    known = F.col("value").isNotNull()
    return both.groupBy(*keys).agg(
        (F.count_if(known & (F.col("a") > 0)) - F.count_if(known & (F.col("b") > 0))).alias("unique_diff"),
        F.sum(divergence_term(p, q)).alias("js_distance"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("new_categories"),
    )


def attach_to_rows(df: DataFrame, profile: DataFrame, date: str) -> DataFrame:
    """Every row with the profile of its date (one profile row per ``period``)."""
    days = profile.withColumn("_day", F.to_date("period")).drop("period")
    return df.withColumn("_day", F.to_date(date)).join(checked_broadcast(days), "_day", "left").drop("_day")


def history_features(rows: DataFrame) -> DataFrame:
    """(period, column, metric, value): numeric history in long form, metrics named ``mean_diff_7d`` and so on."""
    stats_ = ["mean_diff", "median_diff", "std_ratio", "range_ratio", "zscore"]
    long = rows.unpivot([*PC, "window"], stats_, "_s", "value")
    name = F.concat(F.lit("_"), F.col("_s"), F.lit("_"), F.col("window").cast("string"), F.lit("d"))
    return long.select(*PC, name.alias("metric"), "value")
