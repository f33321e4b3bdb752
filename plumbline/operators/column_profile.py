"""Profile of every column of a table: one row per column.

Facts, distinct values, quartiles and samples come from value counts of all columns; moments need one more pass. Whole numbers
and decimals also get exact order statistics (``exact_*``), as a double holds only 53 bits of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import vocab
from plumbline.functions import text
from plumbline.functions.nulls import hits, number, ratio
from plumbline.operators.counts import numeric_long, quantiles_of, text_long, top_values, value_counts
from plumbline.operators.profile_state import Registry
from plumbline.sources.checkpoint import cut
from plumbline.types import columns_by_kind

PATTERN_SHARE = 0.8


def name_is_personal(column: Column, whole_word: bool = False) -> Column:
    """True where a column name holds a personal-data word; ``whole_word`` demands word borders (also ``_``)."""
    if not whole_word:
        return text.contains_any(column, vocab.PII_NAME_INDICATORS)
    words = "|".join(vocab.PII_NAME_INDICATORS)
    return F.lower(column).rlike(rf"(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])")


def _any_value_pattern(c: Column) -> Column:
    hit = F.lit(False)
    for p in vocab.PII_VALUE_PATTERNS:
        hit = hit | text.match_start(c, p)
    return hit


def _semantic_type() -> Column:
    present = F.col("_present").cast("double")
    t = (
        F.when(F.col("_present") == 0, "unknown")
        .when(F.col("_kind") == "boolean", "boolean")
        .when((F.col("_kind") == "numeric") & (F.col("_fractions") == 0), "integer")
        .when(F.col("_kind") == "numeric", "number")
        .when(F.col("_kind") == "temporal", "date")
        .when(F.col("_kind") == "other", "object")
        .when(F.col("_dates") == F.col("_present"), "date")
    )
    for i, (name, _) in enumerate(vocab.SEMANTIC_PATTERNS):
        t = t.when(F.get("_pattern_hits", F.lit(i)) / present > PATTERN_SHARE, name)
    return t.otherwise("string")


def column_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    kinds = columns_by_kind(df)
    booleans = {f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"}
    out = {}
    for c in columns:
        if c in kinds.numeric:
            out[c] = "numeric"
        elif c in booleans:
            out[c] = "boolean"
        elif c in kinds.categorical:
            out[c] = "text"
        elif c in kinds.temporal:
            out[c] = "temporal"
    return out


EXACT = "decimal(38,6)"


def exact_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose numbers are whole or decimal."""
    return [f.name for f in df.schema.fields if f.name in columns and (f.dataType.typeName() in ("byte", "short", "integer", "long", "decimal"))]


def _weighted(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def column_cells(df: DataFrame, kinds: dict[str, str], distinct: bool = True) -> DataFrame:
    """(column, value, n) over all columns as text; with ``distinct`` one row per distinct value, else per row."""
    long = text_long(df, [], list(kinds))
    return value_counts(long, ["column"], keep_null=True) if distinct else long.withColumn("n", F.lit(1))


def scan_cells(cells: DataFrame, kinds: dict[str, str], exact: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per column with the facts read from its cells (internal columns start with ``_``).

    Patterns are tried once per distinct value, not once per row.
    """
    kind = F.col("_kind")
    of = lambda k: [c for c, v in kinds.items() if v == k]
    labelled = cells.withColumn("_kind", F.when(F.col("column").isin(*of("numeric")), "numeric")
                                .when(F.col("column").isin(*of("boolean")), "boolean")
                                .when(F.col("column").isin(*of("temporal")), "temporal").otherwise("text"))
    value = F.col("value")
    ready = labelled.select(
        "column", "_kind", "n", "value",
        F.when(kind == "numeric", number(F.expr("try_cast(value AS double)"))).alias("v"),
        F.when(F.col("column").isin(*exact), F.expr(f"try_cast(value AS {EXACT})")).alias("e"),
        F.when(kind == "text", value).alias("s"),
        F.when(kind == "temporal", F.expr("try_cast(value AS timestamp)"))
        .when(kind == "text", text.parse_date(value)).alias("d"),
    )
    v, s, d = F.col("v"), F.col("s"), F.col("d")
    present = F.when(kind == "numeric", v.isNotNull()).otherwise(value.isNotNull())
    return ready.groupBy(F.col("column").alias("column_name"), "_kind").agg(
        F.sum("n").alias("_rows"),
        _weighted(present).alias("_present"),
        _weighted(v != F.floor(v)).alias("_fractions"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.min("e").alias("exact_min"), F.max("e").alias("exact_max"),
        F.coalesce(F.bool_or(v == 0), F.lit(False)).alias("has_zeros"),
        F.coalesce(F.bool_or(v < 0), F.lit(False)).alias("has_negatives"),
        F.min(F.length(s)).alias("min_length"), F.max(F.length(s)).alias("max_length"),
        ratio(F.sum(F.length(s) * F.col("n")), F.sum(F.when(s.isNotNull(), F.col("n")))).alias("avg_length"),
        F.bool_or(s.rlike(r"\d")).alias("has_numbers"),
        F.bool_or(s.rlike("[a-zA-Z]")).alias("has_letters"),
        F.bool_or(s.rlike(r"[^a-zA-Z0-9\s]")).alias("has_special_chars"),
        F.min(d).alias("min_date"), F.max(d).alias("max_date"),
        _weighted(d.isNotNull()).alias("_dates"),
        F.array(*[_weighted(text.match_start(s, p)) for _, p in vocab.SEMANTIC_PATTERNS]).alias("_pattern_hits"),
        F.coalesce(F.bool_or(_any_value_pattern(s)), F.lit(False)).alias("_personal_values"),
        F.count_if(present).alias("_distinct_cells"),
    )


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, data_type, is_pii): semantic type over all values of each column."""
    kinds = column_kinds(df, list(columns or df.columns))
    scan = scan_cells(column_cells(df, kinds, distinct=False), kinds).withColumn("data_type", _semantic_type())
    return scan.select("column_name", "data_type", _personal().alias("is_pii"))


def _personal(whole_word: bool = False) -> Column:
    return (
        name_is_personal(F.col("column_name"), whole_word)
        | F.col("data_type").isin(*vocab.PII_SEMANTIC_TYPES)
        | ((F.col("data_type") == "string") & F.col("_personal_values"))
    )


QUARTILES = {"median": 0.5, "quartile_1": 0.25, "quartile_3": 0.75}


def _quartiles(cells: DataFrame, floating: list[str], exact: list[str]) -> DataFrame:
    """(column, quartiles, exact quartiles): whole numbers and decimals are ranked and interpolated as decimals."""
    def of(columns: list[str], kind: str) -> DataFrame:
        v = F.expr(f"try_cast(value AS {kind})")
        counts = cells.where(F.col("column").isin(*columns)).select("column", (number(v) if kind == "double" else v).alias("value"), "n")
        return quantiles_of(counts.where(F.col("value").isNotNull()), ["column"], QUARTILES)

    parts = []
    if floating:
        parts.append(of(floating, "double").select("column", *QUARTILES, *[F.lit(None).cast(EXACT).alias(f"exact_{c}") for c in QUARTILES]))
    if exact:
        parts.append(of(exact, EXACT).select("column", *[F.col(c).cast("double").alias(c) for c in QUARTILES], *[F.col(c).alias(f"exact_{c}") for c in QUARTILES]))
    return reduce(DataFrame.unionByName, parts)


def profile_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    limit: int | None = None,
    samples: int = 5,
    approx_distinct: bool = False,
    whole_word: bool = False,
    extra: Registry | None = None,
) -> DataFrame:
    """One row per column: counts, type, statistics that fit the type, smallest distinct values as samples.

    ``approx_distinct`` replaces the exact distinct count by a sketch, which spares the shuffle of all values; samples
    are then left out. ``extra`` adds a column per own metric, from the same cells.
    """
    names = list(columns or df.columns)
    names = names[:limit] if limit else names
    kinds = column_kinds(df, names)
    cells = column_cells(df, kinds, distinct=not approx_distinct)
    exact = exact_columns(df, names)
    out = scan_cells(cells, kinds, exact).withColumn("data_type", _semantic_type())
    if approx_distinct:
        one = df.agg(F.array(*[
            F.struct(F.lit(c).alias("_name"), F.approx_count_distinct(c).alias("distinct_count")) for c in kinds
        ]).alias("_d"))
        side = one.select(F.inline("_d")).withColumn("sample_values", F.lit(None).cast("string"))
    else:
        out = out.withColumn("distinct_count", F.col("_distinct_cells"))
        firsts = top_values(cells.where(F.col("value").isNotNull()).withColumn("n", F.lit(1)), ["column"], samples)
        side = firsts.groupBy(F.col("column").alias("_name")).agg(
            F.array_join(F.array_sort(F.collect_list("value")), "|").alias("sample_values")
        )
    out = out.join(side, out.column_name == side._name, "left")
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    long = numeric_long(df, [], numeric) if numeric else None
    if numeric:
        moments = long.groupBy(F.col("column").alias("_mom_name")).agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
        )
        quart = _quartiles(cells, [c for c in numeric if c not in exact], exact).withColumnRenamed("column", "_quart_name")
        out = out.join(moments, out.column_name == moments._mom_name, "left")
        out = out.join(quart, out.column_name == quart._quart_name, "left")
    else:
        for c in ("mean", "std", "median", "quartile_1", "quartile_3"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        for c in QUARTILES:
            out = out.withColumn(f"exact_{c}", F.lit(None).cast(EXACT))
    own = []
    for kind, value in (("numeric", number(F.expr("try_cast(value AS double)"))), ("text", F.col("value"))):
        fits = [c for c, k in kinds.items() if k == kind]
        if extra and extra.names(kind):
            cells_of = cells.where(F.col("column").isin(*fits)).select(F.col("column").alias("_own_" + kind), value.alias("value"), "n")
            found = extra.of(cells_of, ["_own_" + kind], kind)
            out = out.join(found, out.column_name == found["_own_" + kind], "left")
            own += extra.names(kind)
    is_num = F.col("data_type").isin("number", "integer")
    is_txt = F.col("data_type") == "string"
    is_date = F.col("data_type") == "date"
    keep = lambda cond, name, digits=None: F.when(
        cond, F.round(name, digits) if digits is not None else F.col(name)
    ).alias(name)
    distinct_count = F.coalesce("distinct_count", F.lit(0))
    return out.select(
        "column_name",
        "data_type",
        F.lit(True).alias("nullable"),
        (F.col("_rows") - F.col("_present")).alias("null_count"),
        F.round(F.coalesce(ratio(F.col("_rows") - F.col("_present"), F.col("_rows")), F.lit(0.0)) * 100, 2).alias("null_percentage"),
        distinct_count.alias("distinct_count"),
        F.round(F.coalesce(ratio(distinct_count, F.col("_rows")), F.lit(0.0)) * 100, 2).alias("distinct_percentage"),
        F.coalesce(ratio(distinct_count, F.col("_present")), F.lit(0.0)).alias("unique_ratio"),
        "sample_values",
        keep(is_num, "min"), keep(is_num, "max"), keep(is_num, "mean", 2), keep(is_num, "median"), keep(is_num, "std", 2),
        keep(is_num, "has_zeros"), keep(is_num, "has_negatives"), keep(is_num, "quartile_1"), keep(is_num, "quartile_3"),
        *[keep(is_num, f"exact_{c}") for c in ("min", "max", *QUARTILES)],
        keep(is_txt, "min_length"), keep(is_txt, "max_length"), keep(is_txt, "avg_length", 2),
        keep(is_txt, "has_numbers"), keep(is_txt, "has_letters"), keep(is_txt, "has_special_chars"),
        keep(is_date, "min_date"), keep(is_date, "max_date"),
        F.when(is_date, F.floor((F.unix_timestamp("max_date") - F.unix_timestamp("min_date")) / 86400)).alias("date_range_days"),
        _personal(whole_word).alias("is_pii"),
        *own,
    )


NESTED = {T.ArrayType: "array", T.MapType: "map", T.StructType: "struct", T.BinaryType: "binary"}


class NotProfiled(ValueError):
    """A column type that no profile reads."""


def _leaf(value: Column, dtype: T.DataType) -> Column | None:
    """Text of a scalar, whole for floats; None if the type is no scalar."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value.cast("double").cast("string")
    return value.cast("string") if isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def _paths(name: str, value: Column, dtype: T.DataType) -> tuple[list[Column], dict[str, str]]:
    """Arrays of cells (path, kind, value) that a value gives, and the type of each path.

    A nested value counts as its size under its own path; elements, keys, values and fields follow under ``name[]``, ``name.keys[]``, ``name.values[]`` and ``name.field``.
    """
    cell = lambda path, kind, text: F.struct(F.lit(path).alias("column"), F.lit(kind).alias("_kind"), text.alias("value"))
    leaf = _leaf(value, dtype)
    if leaf is not None:
        kind = "numeric" if isinstance(dtype, T.NumericType) else "boolean" if isinstance(dtype, T.BooleanType) else "text" if isinstance(dtype, T.StringType) else "temporal"
        return [F.array(cell(name, kind, leaf))], {name: dtype.simpleString()}
    if isinstance(dtype, T.StructType):
        cells, types = [F.array(cell(name, "nested", F.when(value.isNotNull(), F.lit(str(len(dtype.fields))))))], {name: "struct"}
        for f in dtype.fields:
            inner, found = _paths(f"{name}.{f.name}", value.getField(f.name), f.dataType)
            cells += inner
            types |= found
        return cells, types
    if isinstance(dtype, T.BinaryType):
        return [F.array(cell(name, "nested", F.octet_length(value).cast("string")))], {name: "binary"}
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        size = F.when(value.isNotNull(), F.size(value)).cast("string")
        cells, types = [F.array(cell(name, "nested", size))], {name: NESTED[type(dtype)]}
        inside = [(f"{name}[]", value, dtype.elementType)] if isinstance(dtype, T.ArrayType) else [
            (f"{name}.keys[]", F.map_keys(value), dtype.keyType), (f"{name}.values[]", F.map_values(value), dtype.valueType)]
        for path, elements, inner in inside:
            _, found = _paths(path, F.lit(None), inner)
            types |= found
            none = F.array().cast("array<struct<column:string,_kind:string,value:string>>")
            cells.append(F.coalesce(F.flatten(F.transform(elements, _element_cells(path, inner))), none))
        return cells, types
    raise NotProfiled(f"type {dtype.simpleString()} is not profiled")


def _element_cells(path: str, dtype: T.DataType):
    return lambda x: F.concat(*_paths(path, x, dtype)[0])


def nested_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The facts of :func:`profile_columns` that fit for nested and binary columns and what lies in them, one row per path, with ``error``.

    For a nested path ``min_length``, ``max_length`` and ``avg_length`` are sizes (elements, entries, bytes, fields) and nothing is told of distinct
    values. Elements count as rows of their path. A column whose type cannot be read gives a row with an error and leaves the others alone.
    """
    skipped = [c for c in (columns or columns_by_kind(df).skipped)]
    cells, types, errors = [], {}, {}
    for c in skipped:
        if c not in df.columns:
            errors[c] = "no column of this name"
            continue
        try:
            made, found = _paths(c, F.col(f"`{c}`"), df.schema[c].dataType)
        except NotProfiled as e:
            errors[c] = str(e)
            continue
        cells += made
        types |= found
    spark = df.sparkSession
    failed = spark.createDataFrame(list(errors.items()), "column_name string, error string")  # one row per failing column
    if not cells:
        return failed.select("column_name", F.lit("unknown").alias("data_type"), *[F.lit(None).cast(t).alias(n) for n, t in _NESTED_FACTS], "error")
    counted = cut(df.select(F.inline(F.concat(*cells))).groupBy("column", "_kind", "value").agg(F.count(F.lit(1)).alias("n")))
    kinds = {r["column"]: r["_kind"] for r in counted.select("column", "_kind").distinct().collect()}  # one row per path of the schema
    size = F.when(F.col("_kind") == "nested", F.col("value").cast("int"))
    plain = {c: k for c, k in kinds.items() if k != "nested"}
    sizes = counted.where(F.col("_kind") == "nested").groupBy("column").agg(
        F.sum("n").alias("_rows"), F.coalesce(F.sum(F.when(size.isNotNull(), F.col("n"))), F.lit(0)).alias("_present"), F.min(size).alias("min_length"), F.max(size).alias("max_length"),
        F.try_divide(F.sum(size * F.col("n")), F.sum(F.when(size.isNotNull(), F.col("n")))).alias("avg_length"))
    null = lambda t: F.lit(None).cast(t)
    label = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    share = F.round(F.coalesce(ratio(F.col("_rows") - F.col("_present"), F.col("_rows")), F.lit(0.0)) * 100, 2)
    nested = sizes.select(
        F.col("column").alias("column_name"), F.element_at(label, F.col("column")).alias("data_type"), (F.col("_rows") - F.col("_present")).alias("null_count"), share.alias("null_percentage"),
        null("bigint").alias("distinct_count"), *[null("double").alias(c) for c in ("min", "max", "mean", "std", "median", "quartile_1", "quartile_3")],
        "min_length", "max_length", F.round("avg_length", 2).alias("avg_length"), null("string").alias("error"))
    out = nested
    if plain:
        flat = counted.where(F.col("_kind") != "nested").select("column", "value", "n")
        facts = scan_cells(flat, plain).withColumn("data_type", _semantic_type())
        v = number(F.expr("try_cast(value AS double)"))
        numbers = flat.where(F.col("column").isin(*[c for c, k in plain.items() if k == "numeric"])).select("column", v.alias("value"), "n").where(F.col("value").isNotNull())
        means = numbers.groupBy("column").agg(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mean"), F.sum("n").alias("_k"))
        spread = numbers.join(means, "column").groupBy("column").agg(
            F.first("mean").alias("mean"), F.sqrt(F.try_divide(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))), F.first("_k") - 1)).alias("std"))
        stats = spread.join(quantiles_of(numbers, ["column"], QUARTILES), "column").withColumnRenamed("column", "_of")
        facts = facts.join(stats, facts.column_name == stats._of, "left")
        text_of = lambda c: F.when(F.col("data_type") == "string", F.col(c)).alias(c)
        out = out.unionByName(facts.select(
            "column_name", "data_type", (F.col("_rows") - F.col("_present")).alias("null_count"), share.alias("null_percentage"), F.col("_distinct_cells").alias("distinct_count"),
            "min", "max", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"), "median", "quartile_1", "quartile_3", text_of("min_length"), text_of("max_length"),
            F.when(F.col("data_type") == "string", F.round("avg_length", 2)).alias("avg_length"), null("string").alias("error")))
    return out.unionByName(failed.select("column_name", F.lit("unknown").alias("data_type"), *[null(t).alias(n) for n, t in _NESTED_FACTS], "error"))


_NESTED_FACTS = [("null_count", "bigint"), ("null_percentage", "double"), ("distinct_count", "bigint"), *[(c, "double") for c in ("min", "max", "mean", "std", "median", "quartile_1", "quartile_3")],
                 ("min_length", "int"), ("max_length", "int"), ("avg_length", "double")]


def profile_table(df: DataFrame, columns: list[str] | None = None, **how) -> DataFrame:
    """:func:`profile_columns` and, in the same columns, :func:`nested_profile`: a row for every column of the table, whatever its type, with ``error``."""
    names = list(columns or df.columns)
    nested = [c for c in names if c not in df.columns or c in columns_by_kind(df).skipped]
    plain = [c for c in names if c not in nested]
    flat = profile_columns(df, plain, **how).withColumn("error", F.lit(None).cast("string")) if plain else None
    if not nested:
        return flat
    inner = nested_profile(df, nested)
    return inner if flat is None else flat.unionByName(inner, allowMissingColumns=True)


def profile_long(profile: DataFrame) -> DataFrame:
    """(column_name, metric, value) with values as text, timestamps in ISO form; NULL metrics are left out."""
    metrics = [c for c in profile.columns if c != "column_name"]
    iso = {f.name for f in profile.schema.fields if f.dataType.typeName().startswith("timestamp")}
    wide = profile.select(
        "column_name",
        *[(F.date_format(m, "yyyy-MM-dd'T'HH:mm:ss") if m in iso else F.col(m).cast("string")).alias(m) for m in metrics],
    )
    return wide.unpivot(["column_name"], metrics, "metric", "value").where(F.col("value").isNotNull())


def personal_column_count(profile: DataFrame) -> DataFrame:
    """(columns, pii_columns)."""
    return profile.agg(F.count(F.lit(1)).alias("columns"), hits(F.col("is_pii")).alias("pii_columns"))
