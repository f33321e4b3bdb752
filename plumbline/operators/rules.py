"""Data-quality rules: definition, default catalogue and validation in one pass.

A rule turns a column into aggregates. All row rules of a run share one aggregate over the table; uniqueness is read
from value counts, because exact distinct counts need the values side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import vocab
from plumbline.functions import text
from plumbline.functions.nulls import hits, number, ratio
from plumbline.operators.counts import text_long, value_counts


@dataclass(frozen=True)
class Rule:
    """One rule. ``kind`` is completeness, format, uniqueness, detection, rows or statistic.

    ``predicate`` (rows, and detection with a custom check) maps a column to a boolean column; wrap a Python function
    with ``pandas_udf`` to use it here. ``statistic`` maps a column to an aggregate that must lie in [low, high].
    """

    name: str
    description: str
    category: str
    kind: str
    pii_type: str | None = None
    severity: int = 3
    parameters: dict = field(default_factory=dict)
    confidence: float = 0.0
    predicate: Callable[[Column], Column] | None = None
    statistic: Callable[[Column], Column] | None = None

    def __post_init__(self):
        object.__setattr__(self, "severity", min(max(1, self.severity), 5))
        object.__setattr__(self, "confidence", min(max(0.0, self.confidence), 1.0))
        if self.category not in vocab.RULE_CATEGORIES:
            raise ValueError(f"unknown rule category {self.category!r}")
        if self.pii_type is not None and self.pii_type not in vocab.PII_TYPES:
            raise ValueError(f"unknown kind of personal data {self.pii_type!r}")

    def with_confidence(self, confidence: float) -> "Rule":
        return replace(self, confidence=confidence)

    def to_dict(self) -> dict:
        return {
            "name": self.name, "description": self.description, "category": self.category, "pii_type": self.pii_type,
            "severity": self.severity, "parameters": dict(self.parameters), "confidence": self.confidence,
        }


def completeness(threshold: float = 0.95, severity: int = 3, name: str = "completeness_check") -> Rule:
    return Rule(name, "Share of values that are present", "completeness", "completeness", None, severity,
                {"threshold": threshold})


def uniqueness(threshold: float = 1.0, severity: int = 3, name: str = "uniqueness_check") -> Rule:
    return Rule(name, "Share of distinct values among those present", "uniqueness", "uniqueness", None, severity,
                {"threshold": threshold})


def value_format(name: str, pattern: str, match_type="all", pii_type: str | None = None, severity: int = 3) -> Rule:
    """``match_type`` is ``all``, ``any`` or a minimum share; anything else fails."""
    return Rule(name, f"Values start with {pattern}", "format", "format", pii_type, severity,
                {"regex_pattern": pattern, "match_type": match_type})


def detection(pii_type: str, pattern: str | None = None, predicate: Callable[[Column], Column] | None = None,
              threshold: float = 0.8, severity: int = 4, name: str | None = None) -> Rule:
    """Personal data found in at least ``threshold`` of the values; without pattern and predicate it finds nothing."""
    params = {"threshold": threshold} | ({"regex_pattern": pattern} if pattern else {})
    return Rule(name or f"{pii_type}_detection", f"Values look like {pii_type}", "privacy", "detection", pii_type,
                severity, params, predicate=predicate)


def row_rule(name: str, predicate: Callable[[Column], Column], threshold: float = 1.0, severity: int = 3,
             category: str = "accuracy", description: str = "", **parameters) -> Rule:
    return Rule(name, description or name, category, "rows", None, severity, {"threshold": threshold, **parameters},
                predicate=predicate)


def statistic_rule(name: str, statistic: Callable[[Column], Column], low: float | None, high: float | None,
                   severity: int = 3) -> Rule:
    return Rule(name, f"{name} in [{low}, {high}]", "accuracy", "statistic", None, severity,
                {"low": low, "high": high}, statistic=statistic)


# Rules named by the documentation of the rule system, in our own definitions.

def type_rule(sql_type: str, threshold: float = 1.0) -> Rule:
    return row_rule("type_check", lambda c: c.try_cast(sql_type).isNotNull(), threshold, category="format", type=sql_type)


def length_rule(low: int, high: int, threshold: float = 1.0) -> Rule:
    return row_rule("length_check", lambda c: F.length(c).between(low, high), threshold, category="format", low=low, high=high)


def allowed_values_rule(values: list, threshold: float = 1.0) -> Rule:
    return row_rule("allowed_values_check", lambda c: c.isin(*values), threshold, category="consistency", values=list(values))


def whitespace_rule(threshold: float = 1.0) -> Rule:
    return row_rule("whitespace_check", lambda c: F.trim(c) == c, threshold, category="format")


def type_consistency_rule(threshold: float = 0.95) -> Rule:
    """Text values are all numbers or all something else; the share of the majority must reach ``threshold``."""
    def majority(c: Column) -> Column:
        n = F.avg(F.when(c.try_cast("double").isNotNull(), 1.0).when(c.isNotNull(), 0.0))
        return F.greatest(n, 1.0 - n)
    return statistic_rule("type_consistency_check", majority, threshold, 1.0)


def range_rule(low: float, high: float, threshold: float = 1.0) -> Rule:
    return row_rule("range_check", lambda c: number(c).between(low, high), threshold, low=low, high=high)


def precision_rule(digits: int, threshold: float = 1.0) -> Rule:
    return row_rule("precision_check", lambda c: F.round(number(c), digits) == number(c), threshold, digits=digits)


def average_rule(low: float, high: float) -> Rule:
    return statistic_rule("average_check", lambda c: F.avg(number(c)), low, high)


def deviation_rule(low: float, high: float) -> Rule:
    return statistic_rule("deviation_check", lambda c: F.stddev_samp(number(c)), low, high)


def date_range_rule(first: str, last: str, threshold: float = 1.0) -> Rule:
    return row_rule("date_range_check", lambda c: F.to_date(c).between(F.lit(first).cast("date"), F.lit(last).cast("date")),
                    threshold, first=first, last=last)


def not_future_rule(as_of: str, threshold: float = 1.0) -> Rule:
    """Dates up to ``as_of``; the day is a parameter so that results can be repeated."""
    return row_rule("future_date_check", lambda c: F.to_date(c) <= F.lit(as_of).cast("date"), threshold, as_of=as_of)


# Texts that count as a boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f", "0", "1")


def boolean_rule(threshold: float = 1.0) -> Rule:
    return row_rule("boolean_check", lambda c: F.lower(c.cast("string")).isin(*BOOLEAN_WORDS), threshold, category="format")


def flag_rate_rule(flag: Callable[[Column], Column], highest: float) -> Rule:
    return statistic_rule("flag_rate_check", lambda c: F.avg(F.when(flag(c), 1.0).when(c.isNotNull(), 0.0)), None, highest)


# Words that end a street in a postal address, and titles before a personal name (our own lists).
ADDRESS_PATTERN = r"(?i)\b\d{1,5}\s+(?:\w+\s){0,4}(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|way|court|ct|place|pl)\b"
NAME_PATTERN = r"^(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+)?[A-Z][a-z'-]+(?:\s+[A-Z]\.)?\s+[A-Z][a-z'-]+$"


def address_rule(pattern: str = ADDRESS_PATTERN, threshold: float = 0.7) -> Rule:
    return detection("address", pattern, threshold=threshold, name="address_pattern_detection")


def name_rule(pattern: str = NAME_PATTERN, threshold: float = 0.7) -> Rule:
    return detection("name", pattern, threshold=threshold, name="name_pattern_detection")


class Catalogue:
    """Rules by name, in order of addition."""

    def __init__(self, rules: list[Rule] | None = None):
        self._rules: dict[str, Rule] = {}
        for r in default_rules() if rules is None else rules:
            self.add(r)

    def add(self, rule: Rule) -> None:
        self._rules[rule.name] = rule

    def get(self, name: str) -> Rule | None:
        return self._rules.get(name)

    def by_category(self, category: str) -> list[Rule]:
        return [r for r in self._rules.values() if r.category == category]

    def by_pii_type(self, pii_type: str) -> list[Rule]:
        return [r for r in self._rules.values() if r.pii_type == pii_type]

    def __iter__(self):
        return iter(self._rules.values())

    def __len__(self):
        return len(self._rules)

    def table(self, spark: SparkSession) -> DataFrame:
        """The catalogue as rows; parameters as a map of text."""
        schema = T.StructType([
            T.StructField("rule_name", T.StringType()), T.StructField("description", T.StringType()),
            T.StructField("category", T.StringType()), T.StructField("pii_type", T.StringType()),
            T.StructField("severity", T.IntegerType()), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        ])
        rows = [(r.name, r.description, r.category, r.pii_type, r.severity,
                 {k: v if isinstance(v, str) else json.dumps(v) for k, v in r.parameters.items()}) for r in self]
        return spark.createDataFrame(rows, schema)


def default_rules() -> list[Rule]:
    """Completeness, seven detections of personal data, uniqueness."""
    high = {"ssn": 5, "credit_card": 5}
    rules = [completeness()]
    rules += [detection(k, p, severity=high.get(k, 4)) for k, p in vocab.CATALOGUE_PATTERNS.items()]
    rules.append(detection("name", threshold=0.7))
    rules.append(uniqueness())
    return rules


def _row_outcome(rule: Rule, c: Column, unicode: bool) -> tuple[Column, Column, float]:
    """(matching rows, counted rows, ratio of an empty column) as aggregates."""
    present = c.isNotNull()
    if rule.kind == "completeness":
        return hits(present), F.count(F.lit(1)), 1.0
    if rule.kind == "format":
        return hits(text.match_start(c, rule.parameters["regex_pattern"], unicode)), F.count(c), 1.0
    if rule.kind == "detection":
        if rule.parameters.get("regex_pattern"):
            return hits(text.search(c, rule.parameters["regex_pattern"], unicode)), F.count(c), 0.0
        if rule.predicate is not None:
            return hits(rule.predicate(c)), F.count(c), 0.0
        return F.lit(0).cast("bigint"), F.count(c), 0.0
    return hits(rule.predicate(c)), F.count(c), 1.0


def _verdict(rule: Rule, value: Column) -> tuple[Column, Column]:
    """(passed, threshold) for the ratio of a row rule."""
    if rule.kind == "format":
        mt = rule.parameters.get("match_type", "all")
        if mt == "all":
            return value == 1.0, F.lit(1.0)
        if mt == "any":
            return value > 0.0, F.lit(0.0)
        try:
            return value >= float(mt), F.lit(float(mt))
        except (TypeError, ValueError):
            return F.lit(False), F.lit(None).cast("double")
    t = float(rule.parameters["threshold"])
    return value >= t, F.lit(t)


def validate(df: DataFrame, checks: list[tuple[str, Rule]], unicode: bool = False) -> DataFrame:
    """One row per (column, rule): passed, match_count, total_count, ratio, threshold, severity."""
    scans, unique = [], []
    for column, rule in checks:
        labels = [F.lit(column).alias("column_name"), F.lit(rule.name).alias("rule_name"),
                  F.lit(rule.category).alias("category"), F.lit(rule.pii_type).cast("string").alias("pii_type"),
                  F.lit(rule.severity).alias("severity")]
        c = F.col(column)
        if rule.kind == "uniqueness":
            unique.append((column, rule))
            continue
        if rule.kind == "statistic":
            value = rule.statistic(c)
            low, high = rule.parameters["low"], rule.parameters["high"]
            inside = F.lit(True)
            if low is not None:
                inside = inside & (value >= low)
            if high is not None:
                inside = inside & (value <= high)
            limit = F.lit(high if high is not None else low).cast("double")
            scans.append(F.struct(*labels, F.coalesce(inside, F.lit(True)).alias("passed"),
                                  F.lit(None).cast("bigint").alias("match_count"), F.count(c).alias("total_count"),
                                  value.cast("double").alias("ratio"), limit.alias("threshold")))
            continue
        match, total, empty = _row_outcome(rule, c, unicode)
        value = F.coalesce(ratio(match, total), F.lit(empty))
        passed, threshold = _verdict(rule, value)
        scans.append(F.struct(*labels, passed.alias("passed"), match.cast("bigint").alias("match_count"),
                              total.alias("total_count"), value.alias("ratio"), threshold.alias("threshold")))
    parts = []
    if scans:
        parts.append(df.agg(F.array(*scans).alias("_r")).select(F.inline("_r")))
    if unique:
        cols = list(dict.fromkeys(c for c, _ in unique))
        counts = value_counts(text_long(df, [], cols), ["column"], keep_null=True).groupBy("column").agg(
            F.count("value").alias("match_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("total_count"),
        )
        spec = df.sparkSession.createDataFrame(
            [(c, r.name, r.category, r.pii_type, r.severity, float(r.parameters["threshold"])) for c, r in unique],
            "column_name string, rule_name string, category string, pii_type string, severity int, threshold double",
        )
        value = F.coalesce(ratio(F.col("match_count"), F.col("total_count")), F.lit(1.0))
        parts.append(
            spec.join(counts, spec.column_name == counts.column, "left").select(
                "column_name", "rule_name", "category", "pii_type", "severity", (value >= F.col("threshold")).alias("passed"),
                F.coalesce("match_count", F.lit(0)).alias("match_count"),
                F.coalesce("total_count", F.lit(0)).alias("total_count"), value.alias("ratio"), "threshold",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
