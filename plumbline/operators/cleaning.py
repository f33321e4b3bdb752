"""Column selection, splits, type repair, missing values and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions.nulls import bounded, number, ratio
from plumbline.operators.counts import quantiles, text_long, value_counts
from plumbline.operators.panel import interpolate
from plumbline.types import columns_by_kind


def banded(c: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first band whose lower limit lies below ``c``."""
    out = None
    for limit, label in bands:
        out = F.when(c > limit, label) if out is None else out.when(c > limit, label)
    return out.otherwise(rest)


def select_kind(df: DataFrame, kind: str, exclude=()) -> DataFrame:
    return df.select(*getattr(columns_by_kind(df, exclude), kind))


def drop_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def target_metrics(metrics: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Metrics ``{target}_*`` of a (period, metric, value) table, with ``target``."""
    if not targets:
        return metrics.withColumn("target", F.lit(None).cast("string"))
    label = None
    for t in targets:
        cond = F.col("metric").startswith(f"{t}_")
        label = F.when(cond, t) if label is None else label.when(cond, t)
    return metrics.withColumn("target", label).where(F.col("target").isNotNull())


def target_feature_names(names: list[str], targets: list[str]) -> list[str]:
    """Base metrics of each target, or at most four engineered ones where it has no base metric."""
    have, out = set(names), []
    for t in targets:
        base = [t + s for s in vocab.TARGET_BASE_SUFFIXES if t + s in have]
        out += base or [t + s for s in vocab.TARGET_ENGINEERED_SUFFIXES if t + s in have][:4]
    return out


def deseasonalised_columns(names: list[str]) -> list[str]:
    return [n for n in names if "_deseasonalized" in n]


def split_by_date(df: DataFrame, period: str, test_from: str, keep_train: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows before ``test_from`` and rows from it on; ``keep_train`` keeps the newest so many training periods."""
    test = df.where(F.col(period) >= F.lit(test_from).cast("timestamp"))
    before = df.where(F.col(period) < F.lit(test_from).cast("timestamp"))
    if keep_train is None:
        return before, test
    newest = before.select(period).distinct().orderBy(F.desc(period)).limit(keep_train)
    return before.join(newest, period, "left_semi"), test


def mark_targets(df: DataFrame, period: str, dates: list[str] | None = None, latest: int = 7) -> DataFrame:
    """Adds ``is_target``: the given dates, or else the latest ``latest`` distinct periods."""
    if dates:
        return df.withColumn("is_target", F.date_format(period, "yyyy-MM-dd").isin(*dates))
    newest = df.select(period).distinct().orderBy(F.desc(period)).limit(latest)
    first = newest.agg(F.min(period)).scalar()
    return df.withColumn("is_target", F.col(period) >= first)


def fill_for_models(df: DataFrame, keep: tuple[str, ...] = (), highest_null_share: float = 0.95) -> DataFrame:
    """Drops columns that are (nearly) all NULL, fills numbers with 0 and other columns with ``unknown``.

    One aggregate decides on the driver which columns stay; only its single row is fetched.
    """
    kinds = columns_by_kind(df, keep)
    cols = [c for c in df.columns if c not in keep]
    absent = {c: number(F.col(c)).isNull() if c in kinds.numeric else F.col(c).isNull() for c in cols}
    shares = df.agg(*[F.avg(F.when(absent[c], 1.0).otherwise(0.0)).alias(c) for c in cols]).first()
    gone = [c for c in cols if shares[c] is not None and shares[c] > highest_null_share]
    out = []
    for c in df.columns:
        if c in gone:
            continue
        if c in kinds.numeric:
            zero = F.lit(0).cast(df.schema[c].dataType)
            out.append(F.when(absent[c], zero).otherwise(F.col(c)).alias(c))
        elif c in kinds.categorical:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def repair_types(df: DataFrame, keep: tuple[str, ...] = (), few: int = 10) -> DataFrame:
    """Text columns: numbers become numeric, comma lists their first number; empty and low-variety ones are dropped.

    Facts per column come from value counts; one small row per text column is fetched to decide.
    """
    texts = [c for c in columns_by_kind(df, keep).categorical if df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return df
    counts = value_counts(text_long(df, [], texts), ["column"])
    facts = {r["column"]: r for r in counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.bool_or(F.col("value").contains(",")).alias("commas"),
        F.bool_and(F.col("value").try_cast("double").isNotNull()).alias("numbers"),
    ).collect()}
    out = []
    for c in df.columns:
        f = facts.get(c)
        if c not in texts:
            out.append(F.col(c))
        elif f is None:
            continue
        elif f["commas"]:
            out.append(F.split(F.col(c), ",")[0].try_cast("double").alias(c))
        elif f["numbers"]:
            out.append(F.col(c).try_cast("double").alias(c))
        elif f["distinct"] >= few:
            out.append(F.col(c))
    return df.select(*out)


def model_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with NULL as 0 and infinities bounded."""
    return df.withColumns({c: bounded(F.col(c)) for c in columns})


def scale(df: DataFrame, columns: list[str], how: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """Standard (population deviation) or min-max scaling with statistics of ``fit_on``; constant columns become 0."""
    low, width = _scaler(fit_on if fit_on is not None else df, columns, how)
    return df.withColumns({
        c: F.when(F.coalesce(width[c], F.lit(0.0)) == 0, F.lit(0.0) * number(F.col(c)))
        .otherwise(ratio(number(F.col(c)) - low[c], F.nullif(width[c], F.lit(0.0)))) for c in columns
    })


def unscale(df: DataFrame, columns: list[str], fit_on: DataFrame, how: str = "standard") -> DataFrame:
    """Inverse of :func:`scale`."""
    low, width = _scaler(fit_on, columns, how)
    return df.withColumns({c: F.col(c) * width[c] + low[c] for c in columns})


def _scaler(df: DataFrame, columns: list[str], how: str) -> tuple[dict[str, Column], dict[str, Column]]:
    if how not in ("standard", "minmax"):
        raise ValueError("how must be 'standard' or 'minmax'")
    fits = []
    for c in columns:
        v = number(F.col(c))
        a, b = (F.avg(v), F.stddev_pop(v)) if how == "standard" else (F.min(v), F.max(v) - F.min(v))
        fits.append(F.struct(a.alias("low"), b.alias("width")).alias(c))
    fit = df.agg(F.struct(*fits)).scalar()
    return {c: fit[c]["low"] for c in columns}, {c: fit[c]["width"] for c in columns}


def anomaly_rows(df: DataFrame, flagged: DataFrame, keys: list[str], order: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` rows of ``df`` whose keys are flagged, for display."""
    return df.join(flagged.select(*keys), keys, "left_semi").orderBy(*order).limit(k)


def positive_for_decomposition(series: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Gaps interpolated, then filled forward and backward; values <= 0 replaced by the 1st percentile of positives."""
    filled = interpolate(series, keys, order, value)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = filled.withColumn(value, F.coalesce(
        F.col(value), F.last(value, ignorenulls=True).over(ahead), F.first(value, ignorenulls=True).over(behind)))
    floor = quantiles(filled.where(F.col(value) > 0), keys, {"_floor": 0.01}, value, buckets=1)
    return filled.join(floor, keys, "left").withColumn(
        value, F.when((F.col(value) <= 0) & F.col("_floor").isNotNull(), F.col("_floor")).otherwise(F.col(value))
    ).drop("_floor")
