"""Rule suggestion from profiles and model scores, parsing of model text, agreement of two suggestion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions import text
from plumbline.functions.nulls import ratio
from plumbline.operators.counts import numeric_long, text_long
from plumbline.operators.rules import Catalogue

UNIQUE_SHARE = 0.9


def clamp_confidence(c: Column) -> Column:
    d = c.cast("double")
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def clamp_severity(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), c))


def pii_severity_of(pii_type: Column) -> Column:
    """Default severity of a kind of personal data, as an expression."""
    out = None
    for level in (5, 4):
        names = [k for k, v in vocab.PII_SEVERITY.items() if v == level]
        cond = pii_type.isin(*names)
        out = F.when(cond, level) if out is None else out.when(cond, level)
    return out.otherwise(vocab.PII_SEVERITY_DEFAULT)


def suggest_rules(profile: DataFrame, scores: DataFrame | None, catalogue: Catalogue | None = None) -> DataFrame:
    """Suggested rules per column, best confidence first (``position``).

    ``profile`` has (column_name, unique_ratio); ``scores`` has (column_name, label, confidence), where a label is a
    kind of personal data or the name or category of a rule. Completeness is always suggested, with confidence 0.
    """
    cat = catalogue or Catalogue()
    table = cat.table(profile.sparkSession)
    columns = profile.select("column_name")
    parts = [_attach(columns.select("column_name", F.lit("completeness_check").alias("rule_name"), F.lit(0.0).alias("confidence")), table)]
    if scores is not None:
        known = scores.join(columns, "column_name", "left_semi")
        personal = table.where(F.col("pii_type").isNotNull()).select(F.col("pii_type").alias("label"), "rule_name")
        by_name = table.select(F.col("rule_name").alias("label"), "rule_name")
        by_category = table.where(F.col("pii_type").isNull() & (F.col("category") != F.col("rule_name"))).select(
            F.col("category").alias("label"), "rule_name"
        )
        labels = F.broadcast(personal.unionByName(by_name).unionByName(by_category))  # one row per catalogued rule and label
        hit = known.join(labels, "label").select("column_name", "rule_name", clamp_confidence(F.col("confidence")).alias("confidence"))
        parts.append(_attach(hit.where(F.col("rule_name") != "completeness_check"), table))
    unique = profile.where(F.col("unique_ratio") > UNIQUE_SHARE).select(
        "column_name", F.lit("uniqueness_check").alias("rule_name"), clamp_confidence(F.col("unique_ratio")).alias("confidence")
    )
    parts.append(_attach(unique, table))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy("column_name", "rule_name", "category", "pii_type", "severity", "description").agg(
        F.max("confidence").alias("confidence"), F.first("parameters").alias("parameters")
    )
    return best.withColumn("position", _position())


def _position() -> Column:
    return F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("confidence"), "rule_name"))


def _attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(table), "rule_name")  # the catalogue: a handful of rules built on the driver


def format_recommendations(suggested: DataFrame) -> DataFrame:
    """One row per column: its suggestions as an array of structs, best first."""
    item = F.struct("position", "rule_name", "description", "category", "confidence", "severity", "parameters", "pii_type")
    return suggested.groupBy("column_name").agg(F.array_sort(F.collect_list(item), lambda a, b: a["position"] - b["position"]).alias("recommendations"))


def rules_json(suggested: DataFrame) -> DataFrame:
    """(column_name, rule_name, rule_json)."""
    body = F.struct("rule_name", "description", "category", "pii_type", "severity", "parameters", "confidence")
    return suggested.select("column_name", "rule_name", F.to_json(body).alias("rule_json"))


def parse_scores(df: DataFrame, model_text: str) -> DataFrame:
    """Adds ``scores`` (map of label to number), ``regex_pattern`` and ``items`` (list form) read from free model text.

    The outermost JSON object and, apart from it, an object that holds ``regex_pattern`` are used; text without
    readable JSON gives an empty map.
    """
    c = F.col(model_text)
    body = text.outer_json(c)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    block = F.regexp_extract(c, r'(?s)(\{[^{}]*"regex_pattern"[^{}]*\})', 1)
    return df.select(
        "*",
        F.coalesce(
            F.map_filter(F.transform_values(F.from_json(body, "map<string,string>"), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull()), empty
        ).alias("scores"),
        F.get_json_object(F.nullif(block, F.lit("")), "$.regex_pattern").alias("regex_pattern"),
        F.from_json(
            text.outer_list(c), "array<struct<rule_type:string,confidence:double,parameters:map<string,string>>>"
        ).alias("items"),
    )


def score_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, confidence): one row per parsed score."""
    return parsed.select(*keys, F.explode("scores").alias("label", "confidence"))


def known_recommendations(parsed: DataFrame, keys: list[str], catalogue: Catalogue | None = None, model_id: str = "") -> DataFrame:
    """List-form suggestions whose rule type is catalogued, with their provenance."""
    cat = catalogue or Catalogue()
    known = sorted({r.name for r in cat} | {r.category for r in cat} | {r.pii_type for r in cat if r.pii_type})
    rows = parsed.select(*keys, F.inline("items")).where(F.col("rule_type").isin(*known))
    return rows.withColumn("source", F.lit("ml_recommendation")).withColumn("model_id", F.lit(model_id))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two suggestion lists (column_name, rule_name, confidence) per column: both, only one, agreement rate."""
    a = left.select("column_name", "rule_name", F.col("confidence").alias("_a"))
    b = right.select("column_name", "rule_name", F.col("confidence").alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    joined = a.join(b, ["column_name", "rule_name"], "full_outer")
    return joined.groupBy("column_name").agg(
        F.count_if(both).alias("agreed"),
        F.count_if(F.col("_b").isNull()).alias("only_first"),
        F.count_if(F.col("_a").isNull()).alias("only_second"),
        ratio(F.count_if(both), F.count(F.lit(1))).alias("agreement"),
        F.avg(F.when(both, (F.col("_a") + F.col("_b")) / 2)).alias("mean_confidence"),
    )


def confidence_of(profile: DataFrame) -> DataFrame:
    """Statistical confidence per column from its profile facts.

    Needs (column_name, null_ratio, unique_ratio, match_ratio, within_3_sigma, length_cv); our own definitions:
    completeness is logistic in the null ratio, uniqueness logistic in its distance to 0.95 in steps of 0.05, range is
    the share within three deviations relative to the empirical rule, format the match ratio, text consistency
    one minus the variation of length.
    """
    logistic = lambda x: 1.0 / (1.0 + F.exp(-x))
    return profile.select(
        "column_name",
        logistic((F.lit(0.2) - F.col("null_ratio")) * 20).alias("completeness_confidence"),
        logistic((F.col("unique_ratio") - 0.95) / 0.05).alias("uniqueness_confidence"),
        clamp_confidence(F.col("within_3_sigma") / 0.997).alias("range_confidence"),
        clamp_confidence(F.col("match_ratio")).alias("format_confidence"),
        clamp_confidence(1 - F.col("length_cv")).alias("consistency_confidence"),
    )


def confidence_facts(df: DataFrame, numeric: list[str], texts: list[str], pattern: str) -> DataFrame:
    """The facts :func:`confidence_of` reads, for number and text columns, in two passes without a shuffle of rows."""
    num = numeric_long(df, [], numeric)
    stats = num.groupBy("column").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    inside = F.abs(F.col("value") - F.col("_m")) <= 3 * F.col("_s")
    nums = num.join(F.broadcast(stats), "column").groupBy(F.col("column").alias("column_name")).agg(  # one row per column
        F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("null_ratio"),
        F.avg(F.when(inside, 1.0).when(F.col("value").isNotNull(), 0.0)).alias("within_3_sigma"),
        F.lit(None).cast("double").alias("match_ratio"), F.lit(None).cast("double").alias("length_cv"),
    )
    v = F.col("value")
    txts = text_long(df, [], texts).groupBy(F.col("column").alias("column_name")).agg(
        F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("null_ratio"),
        F.lit(None).cast("double").alias("within_3_sigma"),
        F.avg(F.when(text.match_start(v, pattern), 1.0).when(v.isNotNull(), 0.0)).alias("match_ratio"),
        ratio(F.stddev_pop(F.length(v)), F.avg(F.length(v))).alias("length_cv"),
    )
    return nums.unionByName(txts)
