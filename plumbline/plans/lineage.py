"""Registered queries: schema lineage over job logs read from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import lineage
from plumbline.plans.features import order_days
from plumbline.plans.registry import Query
from plumbline.sources.checkpoint import stored


def job_log(t):
    """Schema snapshots: orders are jobs, their lines stages, parts the columns, return flags the types."""
    cols = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("job"), F.col("l_linenumber").alias("stage_no"), F.lit("stage").alias("stage"),
        F.explode(F.array(F.concat(F.lit("p"), F.col("l_partkey") % 7), F.concat(F.lit("s"), F.col("l_suppkey") % 3))).alias("column"),
        F.col("l_returnflag").alias("type"))
    return cols.groupBy("job", "stage_no", "stage", "column").agg(F.min("type").alias("type"))


_LOG = """c AS (SELECT CAST(l_orderkey AS VARCHAR) AS job, l_linenumber AS stage_no, unnest(['p' || (l_partkey % 7), 's' || (l_suppkey % 3)]) AS col, l_returnflag AS type FROM lineitem),
log AS (SELECT job, stage_no, col, min(type) AS type FROM c GROUP BY 1, 2, 3), st AS (SELECT job, stage_no, lag(stage_no) OVER (PARTITION BY job ORDER BY stage_no) AS prev FROM (SELECT DISTINCT job, stage_no FROM log) AS q),
a AS (SELECT log.job, log.stage_no, col, type FROM log JOIN st ON log.job = st.job AND log.stage_no = st.stage_no WHERE prev IS NOT NULL),
b AS (SELECT log.job, st.stage_no, col, type FROM log JOIN st ON log.job = st.job AND log.stage_no = st.prev),
j AS (SELECT coalesce(a.job, b.job) AS job, coalesce(a.stage_no, b.stage_no) AS stage_no, coalesce(a.col, b.col) AS col, b.type AS was, a.type AS now FROM a FULL OUTER JOIN b ON a.job = b.job AND a.stage_no = b.stage_no AND a.col = b.col)"""


def joined(df, cols):
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


CHANGE_COLS = ["input_columns", "output_columns", "new_columns", "dropped_columns", "kept_columns", "retyped_columns"]


def _agg(name: str, cond: str) -> str:
    return f"coalesce(string_agg(col, ',' ORDER BY col) FILTER (WHERE {cond}), '') AS {name}"


def edges(t):
    """Customer to order, order to part, part to supplier."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = t.orders.select(node("c", "o_custkey").alias("source"), node("o", "o_orderkey").alias("target"))
    b = t.lineitem.select(node("o", "l_orderkey").alias("source"), node("p", "l_partkey").alias("target"))
    c = t.lineitem.select(node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target"))
    return a.unionByName(b).unionByName(c)


def impact_of_customers(t):
    starts = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    return lineage.impact(edges(t), starts).groupBy("start").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


def reach_of_customers(t):
    """Sketched sizes of what each customer's data reaches, and whether they lie within a tenth of the exact numbers."""
    sketched = lineage.reach_sizes(edges(t))  # first, so that its tables are gone before the pairs are stored
    exact = impact_of_customers(t).select(F.col("start").alias("node"), F.col("nodes").alias("exact"))
    close = F.abs(F.coalesce("nodes", F.lit(1)) - F.col("exact")) <= 0.1 * F.col("exact") + 1
    return exact.join(sketched, "node", "left").select(F.col("node").alias("start"), "exact", close.alias("close"))


def answers(t):
    """Model answers with column edges, made from orders; some are broken."""
    body = F.format_string('Sure: {"lineage": [{"source_columns": ["%s", "b"], "target_column": "t", "operation": "%s"}]}', F.col("o_orderstatus"), F.col("o_orderpriority"))
    return t.orders.select(F.col("o_orderkey").cast("string").alias("job"), F.lit(1).alias("stage_no"),
                           F.when(F.col("o_orderkey") % 5 == 0, F.lit("no idea")).otherwise(body).alias("answer"))


def checked_edges(t):
    changes = stored(lineage.schema_changes(job_log(t)).select("job", "stage_no", "input_columns", "output_columns"))  # read for edges and facts
    e = changes.select("job", "stage_no", F.explode(F.array(F.lit("p1"), F.lit("s1"))).alias("source"), F.lit("p2").alias("target"), F.lit("copy").alias("operation"))
    return lineage.check_edges(e, changes).groupBy("source", "known_source", "known_target").agg(F.count(F.lit(1)).alias("n"))


QUERIES = [
    Query("schema_changes", "job:s stage_no:i " + " ".join(f"{c}:s" for c in CHANGE_COLS), lambda t: joined(lineage.schema_changes(job_log(t)), CHANGE_COLS),
          f"""WITH {_LOG} SELECT job, stage_no, {_agg('input_columns', 'was IS NOT NULL')}, {_agg('output_columns', 'now IS NOT NULL')}, {_agg('new_columns', 'was IS NULL')},
 {_agg('dropped_columns', 'now IS NULL')}, {_agg('kept_columns', 'was IS NOT NULL AND now IS NOT NULL')}, {_agg('retyped_columns', 'was <> now')} FROM j GROUP BY 1, 2"""),
    Query("lineage_edges", "job:s stage_no:i source:s target:s operation:s", lambda t: lineage.parse_edges(answers(t), "answer"),
          """SELECT CAST(o_orderkey AS VARCHAR) AS job, 1 AS stage_no, unnest([o_orderstatus, 'b']) AS source, 't' AS target, o_orderpriority AS operation FROM orders WHERE o_orderkey % 5 <> 0"""),
    Query("lineage_checked", "source:s known_source:b known_target:b n:i", checked_edges,
          f"""WITH {_LOG}, g AS (SELECT job, stage_no, list(col) FILTER (WHERE was IS NOT NULL) AS i, list(col) FILTER (WHERE now IS NOT NULL) AS o FROM j GROUP BY 1, 2),
 e AS (SELECT *, unnest(['p1', 's1']) AS source FROM g) SELECT source, coalesce(list_contains(i, source), false) AS known_source, coalesce(list_contains(o, 'p2'), false) AS known_target, count(*) AS n FROM e GROUP BY 1, 2, 3"""),
    Query("lineage_reach", "start:s exact:i close:b", reach_of_customers,
          """WITH l0 AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node FROM customer),
 l1 AS (SELECT DISTINCT start, 'o' || o_orderkey AS node FROM l0 JOIN orders ON node = 'c' || o_custkey), l2 AS (SELECT DISTINCT start, 'p' || l_partkey AS node FROM l1 JOIN lineitem ON node = 'o' || l_orderkey),
 ps AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), l3 AS (SELECT DISTINCT start, s AS node FROM l2 JOIN ps ON node = p)
 SELECT start, count(*) AS exact, true AS close FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) AS u GROUP BY 1"""),
    Query("lineage_closure", "start:s nodes:i depth:i", impact_of_customers,
          """WITH l0 AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS depth FROM customer),
 l1 AS (SELECT DISTINCT start, 'o' || o_orderkey AS node, 1 AS depth FROM l0 JOIN orders ON node = 'c' || o_custkey),
 l2 AS (SELECT DISTINCT start, 'p' || l_partkey AS node, 2 AS depth FROM l1 JOIN lineitem ON node = 'o' || l_orderkey),
 ps AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), l3 AS (SELECT DISTINCT start, s AS node, 3 AS depth FROM l2 JOIN ps ON node = p)
 SELECT start, count(*) AS nodes, max(depth) AS depth FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) AS u GROUP BY 1"""),
]
