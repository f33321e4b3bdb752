"""Registered queries: rule validation, detection of personal data, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import column_profile, rules, suggest
from plumbline.plans.registry import Query
from plumbline.plans.sqltext import sql_string

CHECK_LAYOUT = "column_name:s rule_name:s passed:b match_count:i total_count:i ratio:f threshold:f severity:i"
PII = list(vocab.CATALOGUE_PATTERNS.items())
_SEV = {"ssn": 5, "credit_card": 5}


def duck_pattern(p: str) -> str:
    """A final ``$`` also matches before a closing line break, as in Java."""
    return p[:-1] + r"\n?$" if p.endswith("$") else p


def _check_sql(table: str, col: str, name: str, match: str, total: str, threshold: float, severity: int, empty: float,
               passed: str | None = None) -> str:
    r = f"coalesce(({match}) / CAST(nullif({total}, 0) AS DOUBLE), {empty})"
    ok = (passed or "{r} >= " + str(threshold)).format(r=r)
    return (f"SELECT '{col}' AS column_name, '{name}' AS rule_name, {ok} AS passed, {match} AS match_count, "
            f"{total} AS total_count, {r} AS ratio, {threshold} AS threshold, {severity} AS severity FROM {table}")


def _rows_sql(table, col, name, cond, threshold=1.0, severity=3):
    return _check_sql(table, col, name, f"count(*) FILTER (WHERE {cond})", f"count({col})", threshold, severity, 1.0)


def _pii_sql(table: str, col: str) -> str:
    parts = [_check_sql(table, col, f"{k}_detection", f"count(*) FILTER (WHERE regexp_matches({col}, {sql_string(duck_pattern(p))}))",
                        f"count({col})", 0.8, _SEV.get(k, 4), 0.0) for k, p in PII]
    parts.append(_check_sql(table, col, "name_detection", "0", f"count({col})", 0.7, 4, 0.0))
    return "\nUNION ALL\n".join(parts)


def sparse_customer(t):
    return t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 15 != 0, F.col("c_mktsegment")))


SPARSE_CUSTOMER = "(SELECT *  REPLACE (CASE WHEN c_custkey % 15 <> 0 THEN c_mktsegment END AS c_mktsegment) FROM customer) AS c"
CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _customer_checks():
    return [(c, r) for c in CUST_COLS for r in (rules.completeness(), rules.uniqueness())]


def _documented_checks():
    return [
        ("c_acctbal", rules.type_rule("double")), ("c_name", rules.type_rule("double", 0.5)),
        ("c_name", rules.length_rule(5, 18)), ("c_mktsegment", rules.allowed_values_rule(["BUILDING", "MACHINERY", "HOUSEHOLD"], 0.5)),
        ("c_name", rules.whitespace_rule()), ("c_name", rules.type_consistency_rule()),
        ("c_acctbal", rules.range_rule(0, 9000, 0.9)), ("c_acctbal", rules.precision_rule(1, 0.5)),
        ("c_acctbal", rules.average_rule(4000, 5000)), ("c_acctbal", rules.deviation_rule(100, 200)),
        ("c_mktsegment", rules.boolean_rule()), ("c_mktsegment", rules.flag_rate_rule(lambda c: c == "BUILDING", 0.1)),
        ("c_name", rules.name_rule()), ("c_name", rules.address_rule()),
    ]


def _stat_sql(col, name, expr, low, high):
    conds = [f"{expr} >= {low}"] * (low is not None) + [f"{expr} <= {high}"] * (high is not None)
    return (f"SELECT '{col}' AS column_name, '{name}' AS rule_name, {' AND '.join(conds)} AS passed, CAST(NULL AS BIGINT) AS match_count, "
            f"count({col}) AS total_count, {expr} AS ratio, {high if high is not None else low} AS threshold, 3 AS severity FROM {SPARSE_CUSTOMER}")


_NUMERIC_SHARE = "avg(CASE WHEN try_cast(c_name AS DOUBLE) IS NOT NULL THEN 1.0 WHEN c_name IS NOT NULL THEN 0.0 END)"
_DOCUMENTED_SQL = "\nUNION ALL\n".join([
    _rows_sql(SPARSE_CUSTOMER, "c_acctbal", "type_check", "try_cast(c_acctbal AS DOUBLE) IS NOT NULL"),
    _rows_sql(SPARSE_CUSTOMER, "c_name", "type_check", "try_cast(c_name AS DOUBLE) IS NOT NULL", 0.5),
    _rows_sql(SPARSE_CUSTOMER, "c_name", "length_check", "length(c_name) BETWEEN 5 AND 18"),
    _rows_sql(SPARSE_CUSTOMER, "c_mktsegment", "allowed_values_check", "c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')", 0.5),
    _rows_sql(SPARSE_CUSTOMER, "c_name", "whitespace_check", "trim(c_name) = c_name"),
    _stat_sql("c_name", "type_consistency_check", f"greatest({_NUMERIC_SHARE}, 1.0 - {_NUMERIC_SHARE})", 0.95, 1.0),
    _rows_sql(SPARSE_CUSTOMER, "c_acctbal", "range_check", "c_acctbal BETWEEN 0 AND 9000", 0.9),
    _rows_sql(SPARSE_CUSTOMER, "c_acctbal", "precision_check", "round(c_acctbal, 1) = c_acctbal", 0.5),
    _stat_sql("c_acctbal", "average_check", "avg(c_acctbal)", 4000, 5000),
    _stat_sql("c_acctbal", "deviation_check", "stddev_samp(c_acctbal)", 100, 200),
    _rows_sql(SPARSE_CUSTOMER, "c_mktsegment", "boolean_check", "lower(c_mktsegment) IN ('true','false','yes','no','y','n','t','f','0','1')"),
    _stat_sql("c_mktsegment", "flag_rate_check", "avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 WHEN c_mktsegment IS NOT NULL THEN 0.0 END)", None, 0.1),
    _check_sql(SPARSE_CUSTOMER, "c_name", "name_pattern_detection",
               f"count(*) FILTER (WHERE regexp_matches(c_name, {sql_string(duck_pattern(rules.NAME_PATTERN))}))", "count(c_name)", 0.7, 4, 0.0),
    _check_sql(SPARSE_CUSTOMER, "c_name", "address_pattern_detection",
               f"count(*) FILTER (WHERE regexp_matches(c_name, {sql_string(rules.ADDRESS_PATTERN)}))", "count(c_name)", 0.7, 4, 0.0),
])


def format_checks():
    p = r"Customer#\d+"
    return [("c_name", rules.value_format("name_all", p)), ("c_name", rules.value_format("name_any", "Customer#0000000", "any")),
            ("c_name", rules.value_format("name_share", r".*[02468]$", 0.4)), ("c_name", rules.value_format("name_bad", p, "most")),
            ("c_mktsegment", rules.value_format("segment_letters", "[A-Z]{9}$", 0.6))]


def _format_sql() -> str:
    m = lambda col, p: f"count(*) FILTER (WHERE regexp_matches({col}, {sql_string('^(?:' + duck_pattern(p) + ')')}))"
    row = lambda col, n, p, t, ok: _check_sql(SPARSE_CUSTOMER, col, n, m(col, p), f"count({col})", t, 3, 1.0, ok)
    return "\nUNION ALL\n".join([
        row("c_name", "name_all", r"Customer#\d+", "1.0", "{r} = 1.0"), row("c_name", "name_any", "Customer#0000000", "0.0", "{r} > 0.0"),
        row("c_name", "name_share", r".*[02468]$", "0.4", "{r} >= 0.4"), row("c_name", "name_bad", r"Customer#\d+", "CAST(NULL AS DOUBLE)", "false"),
        row("c_mktsegment", "segment_letters", "[A-Z]{9}$", "0.6", "{r} >= 0.6"),
    ])


def detect_personal(df, columns):
    checks = [(c, r) for c in columns for r in rules.Catalogue() if r.kind == "detection"]
    return rules.validate(df, checks)


def suggestions(t):
    """Shares of matching values stand in for model confidences."""
    scores = detect_personal(t.documents, ["text", "lang"]).unionByName(detect_personal(t.documents, ["source"])).select(
        "column_name", F.col("pii_type").alias("label"), F.col("ratio").alias("confidence"))
    profile = column_profile.profile_columns(t.documents).select("column_name", "unique_ratio")
    return suggest.suggest_rules(profile, scores)


DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
_PII_ROWS = "\nUNION ALL\n".join(_pii_sql("documents", c) for c in ("text", "lang", "source"))
_SUGGEST_SQL = f"""WITH scores AS ({_PII_ROWS}),
profile AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) AS u FROM documents" for c in DOC_COLS)}),
picked AS (SELECT column_name, 'completeness_check' AS rule_name, 'completeness' AS category, CAST(NULL AS VARCHAR) AS pii_type, 3 AS severity, 0.0 AS confidence FROM profile
UNION ALL SELECT column_name, rule_name, 'privacy', replace(rule_name, '_detection', ''), severity, ratio FROM scores
UNION ALL SELECT column_name, 'uniqueness_check', 'uniqueness', NULL, 3, u FROM profile WHERE u > 0.9)
SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY confidence DESC, rule_name) AS position FROM picked"""


def model_texts(t):
    """Model answers made from event properties: wrapped, cut off, or without any JSON."""
    e = F.col("event_id")
    body = F.when(e % 11 == 0, F.lit("no scores here")).when(e % 13 == 0, F.lit('broken {"k": ')).when(
        e % 17 == 0, F.concat(F.lit('{"k": 1, "regex_pattern": "^a+$"} for '), F.col("event_type"))).otherwise(
        F.concat(F.lit("scores for "), F.col("event_type"), F.lit(":\n"), F.col("props"), F.lit("\nend")))
    return t.events.select("event_id", body.alias("answer"))


_MODEL_SQL = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no scores here' WHEN event_id % 13 = 0 THEN 'broken {"k": '
  WHEN event_id % 17 = 0 THEN '{"k": 1, "regex_pattern": "^a+$"} for ' || event_type
  ELSE 'scores for ' || event_type || ':' || chr(10) || props || chr(10) || 'end' END AS answer FROM events"""


def two_lists(t):
    s = suggestions(t).select("column_name", "rule_name", "confidence")
    return suggest.agreement(s.where(F.col("confidence") < 0.5), s.where(F.col("confidence") > 0))


QUERIES = [
    Query("rules_customer", CHECK_LAYOUT, lambda t: rules.validate(sparse_customer(t), _customer_checks()),
          "\nUNION ALL\n".join(
              _check_sql(SPARSE_CUSTOMER, c, "completeness_check", f"count({c})", "count(*)", 0.95, 3, 1.0) + "\nUNION ALL\n" +
              _check_sql(SPARSE_CUSTOMER, c, "uniqueness_check", f"count(DISTINCT {c})", f"count({c})", 1.0, 3, 1.0) for c in CUST_COLS)),
    Query("format_match_customer", CHECK_LAYOUT, lambda t: rules.validate(sparse_customer(t), format_checks()), _format_sql()),
    Query("pii_scan_documents", CHECK_LAYOUT, lambda t: detect_personal(t.documents, ["text", "lang", "source"]), _PII_ROWS),
    Query("pii_custom_validator", CHECK_LAYOUT,
          lambda t: rules.validate(t.documents, [("text", rules.detection("other", predicate=lambda c: F.length(c) > 500, threshold=0.5))]),
          _check_sql("documents", "text", "other_detection", "count(*) FILTER (WHERE length(text) > 500)", "count(text)", 0.5, 4, 0.0)),
    Query("documented_rules", CHECK_LAYOUT, lambda t: rules.validate(sparse_customer(t), _documented_checks()), _DOCUMENTED_SQL),
    Query("date_rules", CHECK_LAYOUT, lambda t: rules.validate(t.orders, [
        ("o_orderdate", rules.date_range_rule("1995-01-01", "1999-12-31", 0.7)), ("o_orderdate", rules.not_future_rule("2001-06-30"))]),
          _rows_sql("orders", "o_orderdate", "date_range_check", "CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'", 0.7)
          + "\nUNION ALL\n" + _rows_sql("orders", "o_orderdate", "future_date_check", "CAST(o_orderdate AS DATE) <= DATE '2001-06-30'")),
    Query("suggest_rules", "column_name:s rule_name:s category:s pii_type:s severity:i confidence:f position:i", suggestions, _SUGGEST_SQL),
    Query("rule_agreement", "column_name:s agreed:i only_first:i only_second:i agreement:f mean_confidence:f", two_lists,
          f"""WITH s AS (SELECT * FROM ({_SUGGEST_SQL}) AS q), a AS (SELECT * FROM s WHERE confidence < 0.5), b AS (SELECT * FROM s WHERE confidence > 0),
 j AS (SELECT coalesce(a.column_name, b.column_name) AS column_name, a.confidence AS ca, b.confidence AS cb
   FROM a FULL OUTER JOIN b ON a.column_name = b.column_name AND a.rule_name = b.rule_name)
 SELECT column_name, count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL) AS agreed, count(*) FILTER (WHERE cb IS NULL) AS only_first,
  count(*) FILTER (WHERE ca IS NULL) AS only_second, count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL) / CAST(count(*) AS DOUBLE) AS agreement,
  avg((ca + cb) / 2) AS mean_confidence FROM j GROUP BY 1"""),
    Query("parse_scores", "event_id:i label:s confidence:f",
          lambda t: suggest.score_rows(suggest.parse_scores(model_texts(t), "answer"), ["event_id"]),
          f"""WITH m AS ({_MODEL_SQL}), j AS (SELECT event_id, answer, nullif(regexp_extract(answer, '(?s)(\\{{.*\\}})', 1), '') AS body FROM m)
 SELECT event_id, 'k' AS label, CAST(json_extract_string(body, '$.k') AS DOUBLE) AS confidence FROM j
 WHERE body IS NOT NULL"""),
    Query("parse_patterns", "event_id:i regex_pattern:s",
          lambda t: suggest.parse_scores(model_texts(t), "answer").where(F.col("regex_pattern").isNotNull()).select("event_id", "regex_pattern"),
          f"SELECT event_id, '^a+$' AS regex_pattern FROM ({_MODEL_SQL}) AS m WHERE contains(answer, 'regex_pattern')"),
    Query("rule_confidence", "column_name:s completeness_confidence:f uniqueness_confidence:f range_confidence:f format_confidence:f consistency_confidence:f",
          lambda t: suggest.confidence_of(suggest.confidence_facts(
              sparse_customer(t), ["c_acctbal"], ["c_name", "c_mktsegment"], r"[A-Z]+$").join(
                  column_profile.profile_columns(sparse_customer(t), ["c_acctbal", "c_name", "c_mktsegment"]).select("column_name", "unique_ratio"), "column_name")),
          f"""WITH base AS (SELECT * FROM {SPARSE_CUSTOMER}), st AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM base)
 SELECT 'c_acctbal' AS column_name, 1 / (1 + exp(-(0.2 - avg(CASE WHEN c_acctbal IS NULL THEN 1.0 ELSE 0.0 END)) * 20)) AS completeness_confidence,
  1 / (1 + exp(-(count(DISTINCT c_acctbal) / CAST(count(c_acctbal) AS DOUBLE) - 0.95) / 0.05)) AS uniqueness_confidence,
  least(1.0, avg(CASE WHEN abs(c_acctbal - m) <= 3 * s THEN 1.0 ELSE 0.0 END) / 0.997) AS range_confidence,
  CAST(NULL AS DOUBLE) AS format_confidence, CAST(NULL AS DOUBLE) AS consistency_confidence FROM base, st
""" + "".join(f""" UNION ALL SELECT '{c}', 1 / (1 + exp(-(0.2 - avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)) * 20)), 1 / (1 + exp(-(count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) - 0.95) / 0.05)), NULL,
  avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '^(?:[A-Z]+$)') THEN 1.0 ELSE 0.0 END),
  greatest(0, least(1, 1 - stddev_pop(length({c})) / avg(length({c})))) FROM base""" for c in ("c_name", "c_mktsegment"))),
]
