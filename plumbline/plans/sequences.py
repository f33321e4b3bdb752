"""Registered queries: sequences and forecast errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import sequence
from plumbline.plans import detection
from plumbline.plans.features import order_days
from plumbline.plans.flags import MONTHS_SQL, item_months
from plumbline.plans.registry import Query


def scaled_months(t):
    return detection.standardise(item_months(t))


SCALED_SQL = f"""m AS ({MONTHS_SQL}), f AS (SELECT period, metric, coalesce(value, 0) AS value FROM m),
z AS (SELECT period, metric, coalesce((value - avg(value) OVER (PARTITION BY metric)) / nullif(stddev_pop(value) OVER (PARTITION BY metric), 0), 0) AS value FROM f)"""
_PAST = "OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
_ERR = f"""{SCALED_SQL}, p AS (SELECT period, metric, CASE WHEN count(*) {_PAST} = 14 THEN (value - avg(value) {_PAST}) ** 2 END AS e FROM z),
er AS (SELECT period, avg(e) AS error FROM p GROUP BY 1)"""
_SEQ_SQL = f"""WITH {_ERR}, lim AS (SELECT quantile_cont(error, 0.95) AS l, avg(error) AS a FROM er WHERE error IS NOT NULL)
SELECT period, error, coalesce(error / l, a / l) AS score, CASE WHEN coalesce(error / l, a / l) >= 1 THEN 1 ELSE 0 END AS flag FROM er, lim"""


def month_sequences(t):
    wide = t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").alias("period")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return sequence.sliding_sequences(wide.withColumn("series", F.lit("items")), ["series"], "period", ["q", "d"], 6)


def metric_flags(t):
    s = sequence.sequence_scores(scaled_months(t))
    return sequence.metric_errors(scaled_months(t)).join(s.select("period", (F.col("flag") == 1).alias("is_anomaly")), "period")


_MF = f"""{_ERR}, lim AS (SELECT quantile_cont(error, 0.95) AS l FROM er WHERE error IS NOT NULL),
fe AS (SELECT p.period, p.metric AS feature, p.e AS error, er.error / l >= 1 AS is_anomaly FROM p JOIN er ON p.period = er.period, lim WHERE p.e IS NOT NULL)"""


def order_blocks(t):
    return order_days(t).withColumn("value", F.when((F.col("metric") == "orders") | (F.dayofyear("period") % 9 > 1), F.col("value")))


_BLOCKS = """o AS (SELECT date_trunc('day', o_orderdate) AS period, 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1
UNION ALL SELECT date_trunc('day', o_orderdate), 'price', CASE WHEN dayofyear(date_trunc('day', o_orderdate)) % 9 > 1 THEN avg(o_totalprice) END FROM orders GROUP BY 1)"""


def reconstruction(t):
    seq = month_sequences(t)
    errors = sequence.reconstruction_errors(seq, ["series", "period"], ["q", "d"], 4)
    return sequence.reconstruction_scores(errors, ["series"], "period")


def pair_reconstruction(t):
    """Pairs of neighbouring months, projected on their one main direction."""
    wide = t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").alias("period")).agg(F.avg("l_quantity").alias("q"))
    pairs = sequence.sliding_sequences(wide.withColumn("series", F.lit("items")), ["series"], "period", ["q"], 2)
    return sequence.reconstruction_errors(pairs, ["series", "period"], ["q"], 1)


# What one component leaves of two centred values is their part along the other direction of the covariance (a b; b d).
_PAIR_SQL = """WITH w AS (SELECT date_trunc('month', l_shipdate) AS period, avg(l_quantity) AS q FROM lineitem GROUP BY 1),
p AS (SELECT period, lag(q) OVER (ORDER BY period) AS x, q AS y FROM w QUALIFY x IS NOT NULL),
c AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM p),
e AS (SELECT *, (a + d - sqrt((a - d) ** 2 + 4 * b * b)) / 2 AS low FROM c),
v AS (SELECT *, b / sqrt(b * b + (low - a) ** 2) AS u, (low - a) / sqrt(b * b + (low - a) ** 2) AS w FROM e)
SELECT period, (u * (x - mx) + w * (y - my)) ** 2 / 2 AS error FROM p, v"""

QUERIES = [
    Query("pca_recon_pair", "period:d error:f", pair_reconstruction, _PAIR_SQL),
    Query("sequences", "series:s period:d n:i first_q:f last_d:f",
          lambda t: month_sequences(t).select("series", "period", F.size("sequence").alias("n"), F.col("sequence")[0]["q"].alias("first_q"),
                                              F.col("sequence")[5]["d"].alias("last_d")),
          """WITH w AS (SELECT date_trunc('month', l_shipdate) AS period, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1),
 s AS (SELECT period, count(*) OVER v AS n, first_value(q) OVER v AS first_q, d AS last_d FROM w WINDOW v AS (ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
 SELECT 'items' AS series, * FROM s WHERE n = 6"""),
    Query("seq_score", "period:d error:f score:f flag:i", lambda t: sequence.sequence_scores(scaled_months(t)), _SEQ_SQL),
    Query("prefix_forecast", "period:d max_score:f flag:i", lambda t: sequence.prefix_forecast_scores(order_blocks(t)),
          f"""WITH {_BLOCKS}, i AS (SELECT *, row_number() OVER l AS i, count(*) OVER (PARTITION BY metric) AS n, count(value) OVER (PARTITION BY metric) AS have,
  coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM o WINDOW l AS (PARTITION BY metric ORDER BY period)),
 e AS (SELECT *, CASE WHEN count(v) {_PAST} = 14 THEN (v - avg(v) {_PAST}) ** 2 END AS e FROM i WHERE n >= 30 AND 1 - have / CAST(n AS DOUBLE) <= 0.3),
 lim AS (SELECT metric, quantile_cont(e, 0.95) AS l FROM e WHERE i <= floor(n * 0.7) AND e IS NOT NULL GROUP BY 1),
 s AS (SELECT period, CASE WHEN i <= floor(n * 0.7) THEN 0 ELSE coalesce(e / l, 0) END AS s FROM e JOIN lim ON e.metric = lim.metric)
 SELECT period, max(s) AS max_score, CASE WHEN max(s) > 0.5 THEN 1 ELSE 0 END AS flag FROM s GROUP BY 1"""),
    Query("contribution_ratio", "feature:s contribution:f rank:i", lambda t: sequence.contributions(metric_flags(t)),
          f"""WITH {_MF}, c AS (SELECT feature, avg(CASE WHEN is_anomaly THEN error END) / (avg(CASE WHEN NOT is_anomaly THEN error END) + 1e-8) AS contribution FROM fe GROUP BY 1)
 SELECT *, row_number() OVER (ORDER BY contribution DESC, feature) AS rank FROM c"""),
    Query("top_anomalies", "period:d total:f feature:s error:f rank:i", lambda t: sequence.top_anomalies(metric_flags(t), "period"),
          f"""WITH {_MF}, w AS (SELECT period, avg(error) AS total FROM fe WHERE is_anomaly GROUP BY 1 ORDER BY total DESC, period LIMIT 5)
 SELECT fe.period, total, feature, error, row_number() OVER (PARTITION BY fe.period ORDER BY error DESC, feature) AS rank FROM fe JOIN w ON fe.period = w.period QUALIFY rank <= 3"""),
    Query("pca_recon", "period:d error:f threshold:f score:f is_anomaly:b", reconstruction),
]
