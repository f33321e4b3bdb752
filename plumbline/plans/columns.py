"""Registered queries: column profiles, typing, derivation, scaling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import column_profile
from plumbline.plans.registry import Query
from plumbline.plans.sqltext import column_profile_sql, type_sql

ORDER_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"),
              ("o_orderdate", "temporal"), ("o_orderpriority", "text")]
CUSTOMER_COLS = [("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
                 ("c_mktsegment", "text")]
PAGE_COLS = [("page_id", "numeric"), ("url", "text"), ("html", "text")]

PROFILE_LAYOUT = (
    "column_name:s data_type:s nullable:b null_count:i null_percentage:g distinct_count:i distinct_percentage:g "
    "unique_ratio:f min:f max:f mean:g median:f std:g has_zeros:b has_negatives:b quartile_1:f quartile_3:f "
    "min_length:i max_length:i avg_length:g has_numbers:b has_letters:b has_special_chars:b min_date:t max_date:t "
    "date_range_days:i is_pii:b"
)


def sparse_orders(t):
    """Orders with gaps: the price is missing on every tenth order, the priority on every seventh."""
    return t.orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))).withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    )


SPARSE_ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"""

NESTED_LAYOUT = ("column_name:s data_type:s null_count:i null_percentage:g distinct_count:i min:f max:f mean:g median:f std:g quartile_1:f quartile_3:f "
                 "min_length:i max_length:i avg_length:g error:s")


def sparse_embeddings(t):
    """Embeddings with missing vectors and labels."""
    return t.embeddings.select("vec_id", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 4 != 0, F.col("label")).alias("label"),
                               F.struct(F.col("label").alias("kind"), F.col("vec_id").cast("string").alias("code")).alias("tag"), F.encode(F.col("vec_id").cast("string"), "UTF-8").alias("raw"))


_NESTED_SRC = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN embedding END AS embedding, CASE WHEN vec_id % 4 <> 0 THEN label END AS label, label AS kind, CAST(vec_id AS VARCHAR) AS code FROM embeddings),
u AS (SELECT unnest(embedding) AS element FROM e)"""
_EMPTY = "NULL AS distinct_count, NULL AS min, NULL AS max, NULL AS mean, NULL AS median, NULL AS std, NULL AS quartile_1, NULL AS quartile_3"
_FACTS = "data_type, null_count, null_percentage, distinct_count, min, max, mean, median, std, quartile_1, quartile_3, min_length, max_length, avg_length, NULL AS error"


def _nested_sql() -> str:
    scalars = column_profile_sql("SELECT vec_id, label FROM e", [("vec_id", "numeric"), ("label", "numeric")])
    parts = {"embedding[]": column_profile_sql("SELECT element FROM u", [("element", "numeric")]), "tag.kind": column_profile_sql("SELECT kind FROM e", [("kind", "numeric")]),
             "tag.code": column_profile_sql("SELECT code FROM e", [("code", "text")])}
    rows = [f"SELECT column_name, {_FACTS} FROM ({scalars}) AS s"] + [f"SELECT '{n}' AS column_name, {_FACTS} FROM ({q}) AS s" for n, q in parts.items()]
    for name, kind, size in (("embedding", "array", "len(embedding)"), ("tag", "struct", "2"), ("raw", "binary", "strlen(code)")):
        rows.append(f"""SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) - count({size}) AS null_count, round((count(*) - count({size})) * 100.0 / count(*), 2) AS null_percentage, {_EMPTY},
 min({size}) AS min_length, max({size}) AS max_length, round(avg({size}), 2) AS avg_length, NULL AS error FROM e""")
    rows.append(f"SELECT 'gone' AS column_name, 'unknown' AS data_type, NULL AS null_count, NULL AS null_percentage, {_EMPTY}, NULL AS min_length, NULL AS max_length, NULL AS avg_length, 'no column of this name' AS error")
    return f"{_NESTED_SRC}\n" + "\nUNION ALL\n".join(rows)


QUERIES = [
    Query("nested_profile", NESTED_LAYOUT, lambda t: column_profile.profile_table(sparse_embeddings(t), ["vec_id", "embedding", "label", "tag", "raw", "gone"]), _nested_sql()),
    Query("column_profile_orders", PROFILE_LAYOUT, lambda t: column_profile.profile_columns(sparse_orders(t)),
          column_profile_sql(SPARSE_ORDERS_SQL, ORDER_COLS)),
    Query("string_profile_customer", PROFILE_LAYOUT, lambda t: column_profile.profile_columns(t.customer),
          column_profile_sql("SELECT * FROM customer", CUSTOMER_COLS)),
    Query("exact_profile", "column_name:s exact_min:s exact_max:s exact_median:s exact_quartile_1:s exact_quartile_3:s",
          lambda t: column_profile.profile_columns(t.orders.select((F.col("o_orderkey") + 9007199254740992).alias("big_key"), F.col("o_custkey"))),
          """WITH v AS (SELECT 'big_key' AS column_name, CAST(o_orderkey AS HUGEINT) + 9007199254740992 AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY column_name) AS n FROM v),
 q AS (SELECT column_name, min(v) AS lo, max(v) AS hi, {}, {}, {} FROM r GROUP BY 1)
 SELECT column_name, CAST(CAST(lo AS DECIMAL(38, 6)) AS VARCHAR) AS exact_min, CAST(CAST(hi AS DECIMAL(38, 6)) AS VARCHAR) AS exact_max,
  {} AS exact_median, {} AS exact_quartile_1, {} AS exact_quartile_3 FROM q""".format(
              *[f"min(v) FILTER (WHERE i = (n - 1) * {k} // 4) AS l{k}, coalesce(min(v) FILTER (WHERE i = (n - 1) * {k} // 4 + 1), max(v)) AS h{k}, max((n - 1) * {k} % 4) AS f{k}" for k in (1, 2, 3)],
              *[f"CAST((4 * l{k} + (h{k} - l{k}) * f{k}) // 4 AS VARCHAR) || '.' || lpad(CAST(((4 * l{k} + (h{k} - l{k}) * f{k}) % 4) * 250000 AS VARCHAR), 6, '0')" for k in (2, 1, 3)])),
    Query("personal_columns", "columns:i pii_columns:i", lambda t: column_profile.personal_column_count(column_profile.profile_columns(t.customer)),
          f"SELECT count(*) AS columns, count(*) FILTER (WHERE is_pii) AS pii_columns FROM ({column_profile_sql('SELECT * FROM customer', CUSTOMER_COLS)}) AS profile"),
    Query("type_inference_pages", "column_name:s data_type:s is_pii:b", lambda t: column_profile.infer_types(t.pages),
          type_sql("SELECT * FROM pages", PAGE_COLS)),
    Query("column_samples", "column_name:s sample_values:s",
          lambda t: column_profile.profile_columns(t.customer).select("column_name", "sample_values"),
          "\nUNION ALL\n".join(
              f"SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY v) AS sample_values FROM (SELECT DISTINCT "
              f"CAST({c} AS VARCHAR) AS v FROM customer WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)" for c, _ in CUSTOMER_COLS)),
]
