"""Panels: entity by day tables, gap filling, rolling features over rows, interpolation of series.

A busy entity may own a large part of all rows. Filling therefore works on one row per (entity, day), and frames over
rows run inside (entity, month) chunks that carry the last rows of the chunks before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import calendar
from plumbline.functions.nulls import number, ratio
from plumbline.sources.checkpoint import cut


def gap_fill(df: DataFrame, entity: str, ts: str, values: list[str], key: str, attributes: tuple[str, ...] = (), least_rows: int = 2) -> DataFrame:
    """Every (entity, day) between the first and last day of the table; missing values filled forward, then backward.

    Several rows on one day stay several rows. A missing value takes the last value of its day, else the last value
    before, else the next one. Entities with fewer than ``least_rows`` rows are left out: one row forms no series.
    """
    rows = df.where(F.col(ts).isNotNull()).select(
        entity, F.to_date(ts).alias("day"), F.col(ts).alias("_ts"), key, *attributes, *[number(F.col(v)).alias(v) for v in values])
    # One row per (entity, day) carries all that filling needs; spine, span and fills come from it, not from the rows.
    at = lambda v: F.when(F.col(v).isNotNull(), F.struct("_ts", key))
    daily = rows.groupBy(entity, "day").agg(
        F.count(F.lit(1)).alias("_seen"), *[F.min_by(F.struct(a), F.struct("_ts", key))[a].alias(f"_{a}") for a in attributes],
        *[f for v in values for f in (F.max_by(v, at(v)).alias(f"_last_{v}"), F.min_by(v, at(v)).alias(f"_first_{v}"))])
    span = daily.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    entities = daily.groupBy(entity).agg(
        F.sum("_seen").alias("_rows"), *[F.min_by(F.struct(f"_{a}"), "day")[f"_{a}"].alias(f"_all_{a}") for a in attributes]
    ).where(F.col("_rows") >= least_rows).drop("_rows")
    spine = entities.withColumn("day", F.explode(F.sequence(span["lo"], span["hi"], F.expr("interval 1 day"))))
    back = Window.partitionBy(entity).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(entity).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    fills = spine.join(daily, [entity, "day"], "left").select(
        entity, "day", "_seen", *[F.col(f"_all_{a}").alias(f"_{a}") for a in attributes],
        *[F.coalesce(F.last(f"_last_{v}", ignorenulls=True).over(back),
                     F.first(f"_first_{v}", ignorenulls=True).over(ahead)).alias(f"_fill_{v}") for v in values],
    )
    # Rows on the left of an inner join: a day with very many rows can then be split by adaptive execution.
    seen = rows.join(fills, [entity, "day"]).select(
        entity, "day", key, *[F.coalesce(a, f"_{a}").alias(a) for a in attributes], *[F.coalesce(v, f"_fill_{v}").alias(v) for v in values])
    gaps = fills.where(F.col("_seen").isNull()).select(
        entity, "day", F.lit(None).cast(df.schema[key].dataType).alias(key), *[F.col(f"_{a}").alias(a) for a in attributes],
        *[F.col(f"_fill_{v}").alias(v) for v in values])
    return seen.unionByName(gaps)


def keep_long_series(df: DataFrame, entity: str, day: str, min_days: int = 30) -> DataFrame:
    """Rows of entities that were seen on at least ``min_days`` different days."""
    enough = df.groupBy(entity).agg(F.count_distinct(F.to_date(day)).alias("_days")).where(F.col("_days") >= min_days)
    return df.join(enough, entity, "left_semi")


def chunk_tails(df: DataFrame, part: list[str], chunk: str, order: list[str], back: int) -> DataFrame:
    """The last ``back`` rows of each chunk, numbered through each part in ``_no``.

    The rank filter works below the shuffle. The result is small and read twice, so it is cut at a checkpoint.
    """
    newest = Window.partitionBy(*part, chunk).orderBy(*[F.desc(c) for c in order])
    tails = df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= back)
    through = Window.partitionBy(*part).orderBy(chunk, F.desc("_r"))
    return cut(tails.withColumn("_no", F.row_number().over(through)).drop("_r"))


def with_halo(df: DataFrame, tails: DataFrame, part: list[str], chunk: str, back: int) -> DataFrame:
    """``df`` plus, in each chunk, copies of the ``back`` rows before it (``_halo`` true).

    Row frames of up to ``back`` preceding rows over (part, chunk) then equal frames over the whole part. A chunk with T
    tail rows before it needs those numbered T - back + 1 .. T.
    """
    before = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = tails.groupBy(*part, chunk).agg(F.count(F.lit(1)).alias("_k")).select(
        *part, F.col(chunk).alias("_to"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start")
    )
    copies = tails.withColumn("_start", F.explode(F.sequence(F.col("_no"), F.col("_no") + F.lit(back - 1)))).join(
        starts, [*part, "_start"]
    )
    halo = copies.drop(chunk, "_no", "_start").withColumnRenamed("_to", chunk).withColumn("_halo", F.lit(True))
    return df.withColumn("_halo", F.lit(False)).unionByName(halo)


def derived_features(panel: DataFrame, entity: str, day: str, value: str, key: str, window: int = 7) -> DataFrame:
    """Calendar parts, rolling mean and deviation of ``window`` rows, change, percent change and z-score per entity.

    Value features exist for entities with at least ``window`` rows. The panel is read twice.
    """
    base = panel.withColumn("_chunk", F.trunc(day, "month"))
    tails = chunk_tails(base, [entity], "_chunk", [day, key], window)
    # An entity has ``window`` rows exactly if its tails do, as each chunk keeps that many.
    enough = tails.groupBy(entity).agg((F.count(F.lit(1)) >= window).alias("_enough"))
    rows = with_halo(base, tails, [entity], "_chunk", window)
    order = Window.partitionBy(entity, "_chunk").orderBy(day, key)
    frame = order.rowsBetween(-(window - 1), 0)
    v, prev = F.col(value), F.lag(value).over(order)
    rolled = rows.withColumns({
        "_mean": F.avg(v).over(frame), "_std": F.stddev_samp(v).over(frame), "_prev": prev,
    }).where(~F.col("_halo"))
    gate = lambda c: F.when(F.col("_enough"), c)
    out = rolled.join(enough, entity)
    name = lambda s: f"{value}_{s}"
    spread = F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std"))
    first = F.col("_prev").isNull()
    return out.select(
        *panel.columns,
        calendar.day_of_week(F.col(day)).alias("day_of_week"), F.dayofmonth(day).alias("day_of_month"),
        F.month(day).alias("month"), calendar.is_month_end(F.col(day)).alias("is_month_end"),
        gate(F.col("_mean")).alias(name(f"{window}d_mean")), gate(F.col("_std")).alias(name(f"{window}d_std")),
        gate(F.when(first, F.lit(0.0)).otherwise(v - F.col("_prev"))).alias(name("change")),
        gate(F.when(first, F.lit(0.0)).otherwise(ratio(v - F.col("_prev"), F.col("_prev")))).alias(name("pct_change")),
        gate((v - F.col("_mean")) / spread).alias(name("zscore")),
    )


def interpolate(series: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Linear interpolation between the present neighbours, by row position; leading gaps stay NULL.

    Trailing gaps take the last value, as linear interpolation without a right neighbour does in pandas.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = series.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    pos = pos.withColumns({"_p": F.last(at, ignorenulls=True).over(back), "_q": F.first(at, ignorenulls=True).over(ahead)})
    p, q = F.col("_p"), F.col("_q")
    step = ratio((q["v"] - p["v"]) * (F.col("_i") - p["i"]), q["i"] - p["i"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(q.isNull(), p["v"]).otherwise(p["v"] + step)
    return pos.withColumn(value, filled).drop("_i", "_p", "_q")
