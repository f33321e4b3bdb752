"""Registered queries: layers and seasonality of series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import layers, season
from plumbline.plans import detection
from plumbline.plans.features import ORDER_DAYS_SQL, order_days
from plumbline.plans.registry import Query

def order_series(t):
    return order_days(t).withColumn("day", F.to_date("period")).drop("period")


_D = f"d AS (SELECT CAST(period AS DATE) AS day, metric, value FROM ({ORDER_DAYS_SQL}) AS x)"
_PAST = "OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_STAT = f"""{_D}, a AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS i, avg(value) OVER (PARTITION BY metric) AS gm,
 stddev_pop(value) OVER (PARTITION BY metric) AS gs, avg(value) {_PAST} AS pm, stddev_pop(value) {_PAST} AS ps FROM d),
b AS (SELECT *, CASE WHEN i >= 20 THEN ps END AS vol FROM a), c AS (SELECT *, avg(vol) {_PAST} AS vm, stddev_pop(vol) {_PAST} AS vs FROM b),
st AS (SELECT day, metric, value, abs(value - gm) > 3 * gs AS value_anomaly, i >= 20 AND abs(value - pm) > 3 * ps AS trend_anomaly,
 i >= 40 AND abs(vol - vm) > 3 * vs AS volatility_anomaly FROM c)"""


def _season_case(p: int) -> str:
    return {7: "isodow(day) - 1", 12: "month(day) - 1", 30: "least(day(day) - 1, 29)"}[p]


def _seasonal_sql(periods) -> str:
    ctes, hits = [], []
    for p in periods:
        ctes.append(f"""s{p} AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER (PARTITION BY metric) AS total
 FROM (SELECT *, {_season_case(p)} AS pos FROM d) AS q WINDOW w AS (PARTITION BY metric, pos)),
h{p} AS (SELECT day, metric, n > 5 AND total >= {2 * p} AND abs(value - m) / greatest(sd, 1e-8) > 3 AS hit FROM s{p})""")
        hits.append(f"h{p}")
    joins = " ".join(f"JOIN {h} ON d.day = {h}.day AND d.metric = {h}.metric" for h in hits)
    return f"{', '.join(ctes)}, se AS (SELECT d.day, d.metric, d.value, {' OR '.join(h + '.hit' for h in hits)} AS seasonal_anomaly FROM d {joins})"


def _decompose_sql(period: int) -> str:
    half = period // 2
    full = f"count(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    if period % 2:
        trend = f"CASE WHEN {full} = {period} THEN avg(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) END"
    else:
        trend = (f"CASE WHEN {full} = {period + 1} THEN (sum(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
                 f" + (lag(value, {half}) OVER (PARTITION BY metric ORDER BY day) + lead(value, {half}) OVER (PARTITION BY metric ORDER BY day)) / 2) / {period} END")
    return f"""t AS (SELECT *, {trend} AS trend, (row_number() OVER (PARTITION BY metric ORDER BY day) - 1) % {period} AS phase FROM d),
p AS (SELECT metric, phase, avg(value - trend) AS s FROM t GROUP BY 1, 2), q AS (SELECT metric, phase, s - avg(s) OVER (PARTITION BY metric) AS seasonal FROM p),
dec AS (SELECT t.day, t.metric, t.value, t.trend, q.seasonal, t.value - t.trend - q.seasonal AS residual, t.value - q.seasonal AS deseasonalized
  FROM t JOIN q ON t.metric = q.metric AND t.phase = q.phase)"""


_DEC = "day:d metric:s value:f trend:f seasonal:f residual:f deseasonalized:f"
_EXPL = f"""WITH {_D}, {_decompose_sql(7)}, e AS (SELECT *, avg(deseasonalized) OVER (PARTITION BY metric) AS m, stddev_samp(deseasonalized) OVER (PARTITION BY metric) AS s FROM dec)
SELECT day, metric, coalesce(seasonal * 100 / nullif(value, 0), 0) AS seasonal_impact_percent, abs(deseasonalized - m) > 2 * s AS is_anomalous FROM e"""


def daily_parts(t):
    return season.decompose(order_series(t), ["metric"])


def recomposed(t):
    parts = daily_parts(t)
    return season.recompose(parts.select("metric", "day", "deseasonalized"), parts, ["metric", "day"])


def layered(t):
    s = order_series(t)
    past = Window.partitionBy("metric").orderBy("day").rowsBetween(-14, -1)
    guess = s.withColumn("_n", F.count("value").over(past)).withColumn("error", F.abs(F.col("value") - F.avg("value").over(past)))
    errors = guess.where("_n = 14").drop("_n")  # a prediction needs its whole past, so errors start later than the series
    return layers.all_layers(layers.statistical_layer(s, ["metric"], "day"), layers.seasonal_layer(s, ["metric"], "day", periods=(7, 12)),
                             layers.error_layer(errors, ["metric"]), ["metric", "day"])


def _acf_sql():
    parts = " UNION ALL ".join(f"SELECT metric, {k} AS lag, x, lag(x, {k}) OVER (PARTITION BY metric ORDER BY day) AS y FROM c" for k in range(31))
    return f"""WITH {_D}, c AS (SELECT day, metric, value - avg(value) OVER (PARTITION BY metric) AS x FROM d), l AS ({parts})
SELECT metric, lag, sum(x * y) / sum(x * x) AS acf, 1.96 / sqrt(count(*)) AS bound, abs(sum(x * y) / sum(x * x)) > 1.96 / sqrt(count(*)) AS significant FROM l GROUP BY 1, 2"""


GROUP_TARGETS = ["o_totalprice", "o_custkey", "o_orderstatus", "o_discount"]


def order_groups(t):
    """Prices and customers of orders per priority and status; a text column and an unknown one are asked for as well."""
    return detection.detect_groups(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderdate", GROUP_TARGETS)


_GROUP_DAYS = """d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority || '/' || o_orderstatus || '/' || c AS metric, avg(v) AS value
  FROM (SELECT o_orderdate, o_orderpriority, o_orderstatus, unnest(['o_totalprice', 'o_custkey']) AS c, unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS v FROM orders) AS u
  GROUP BY ALL)"""
_GROUP_SQL = f"""WITH {_STAT.replace(_D, _GROUP_DAYS)}, {_seasonal_sql((7,))},
er0 AS (SELECT day, metric, CASE WHEN count(value) OVER w = 14 THEN abs(value - avg(value) OVER w) END AS e FROM d WINDOW w AS (PARTITION BY metric ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
er AS (SELECT metric, avg(e) + 3 * stddev_pop(e) AS th FROM er0 GROUP BY 1),
fl AS (SELECT st.day, st.metric, coalesce(value_anomaly, false) OR coalesce(trend_anomaly, false) OR coalesce(volatility_anomaly, false) OR seasonal_anomaly OR coalesce(e > th, false) AS hit
  FROM st JOIN se ON st.day = se.day AND st.metric = se.metric JOIN er ON st.metric = er.metric JOIN er0 ON st.metric = er0.metric AND st.day = er0.day),
gr AS (SELECT o_orderpriority, o_orderstatus, count(*) AS row_count FROM orders GROUP BY 1, 2 HAVING count(*) >= 30),
fo AS (SELECT metric, count(*) AS day_count, count(*) FILTER (WHERE hit) AS anomaly_count, min(CASE WHEN hit THEN day END) AS first_anomaly, max(CASE WHEN hit THEN day END) AS last_anomaly FROM fl GROUP BY 1),
ta AS (SELECT unnest({GROUP_TARGETS}) AS "column", unnest([NULL, NULL, 'not a number column: string', 'no column of this name']) AS error),
re AS (SELECT o_orderpriority, o_orderstatus, "column", row_count, coalesce(day_count, 0) AS day_count, CASE WHEN error IS NULL THEN coalesce(anomaly_count, 0) END AS anomaly_count,
  first_anomaly, last_anomaly, error FROM gr CROSS JOIN ta LEFT JOIN fo ON metric = o_orderpriority || '/' || o_orderstatus || '/' || "column"),
bg AS (SELECT o_orderpriority || '_' || o_orderstatus AS name, coalesce(sum(anomaly_count), 0) AS n FROM re GROUP BY 1)"""

_STD = "stddev_samp(value)"
QUERIES = [
    Query("detect_groups", "o_orderpriority:s o_orderstatus:s column:s row_count:i day_count:i anomaly_count:i first_anomaly:d last_anomaly:d error:s",
          lambda t: order_groups(t).results, f"{_GROUP_SQL} SELECT * FROM re"),
    Query("detect_groups_summary", "fact:s name:s n:i", lambda t: order_groups(t).summary,
          f"""{_GROUP_SQL} SELECT 'total_groups' AS fact, '' AS name, count(*) AS n FROM bg UNION ALL SELECT 'groups_with_anomalies', '', count(*) FILTER (WHERE n > 0) FROM bg
 UNION ALL SELECT 'total_anomalies', '', sum(n) FROM bg UNION ALL SELECT 'anomalies_by_column', "column", sum(anomaly_count) FROM re WHERE error IS NULL GROUP BY 2
 UNION ALL SELECT 'anomalies_by_group', name, n FROM bg"""),
    Query("stat_layer", "day:d metric:s value_anomaly:b trend_anomaly:b volatility_anomaly:b statistical_anomaly:b",
          lambda t: layers.statistical_layer(order_series(t), ["metric"], "day"),
          f"""WITH {_STAT} SELECT day, metric, coalesce(value_anomaly, false) AS value_anomaly, coalesce(trend_anomaly, false) AS trend_anomaly,
 coalesce(volatility_anomaly, false) AS volatility_anomaly, coalesce(value_anomaly, false) OR coalesce(trend_anomaly, false) OR coalesce(volatility_anomaly, false) AS statistical_anomaly FROM st"""),
    Query("season_layer", "day:d metric:s seasonal_anomaly:b", lambda t: layers.seasonal_layer(order_series(t), ["metric"], "day", periods=(7, 12, 30)),
          f"WITH {_D}, {_seasonal_sql((7, 12, 30))} SELECT * FROM se"),
    Query("season_layer_rows", "seasonal_anomaly:b n:i max_value:f",
          lambda t: layers.seasonal_layer(t.events, [], "ts", periods=(24,)).groupBy("seasonal_anomaly").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")),
          """WITH h AS (SELECT value, abs(value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-8) > 3 AND count(*) OVER w > 5 AS seasonal_anomaly
 FROM events WINDOW w AS (PARTITION BY hour(ts))) SELECT seasonal_anomaly, count(*) AS n, max(value) AS max_value FROM h GROUP BY 1"""),
    Query("season_pattern", "pattern:s position:i mean:f std:f n:i", lambda t: season.seasonal_patterns(t.events, "ts", "value"),
          f"""SELECT 'daily' AS pattern, hour(ts) AS position, avg(value) AS mean, {_STD} AS std, count(*) AS n FROM events GROUP BY 2
 UNION ALL SELECT 'weekly', isodow(ts) - 1, avg(value), {_STD}, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'monthly', month(ts), avg(value), {_STD}, count(*) FROM events GROUP BY 2"""),
    Query("acf", "metric:s lag:i acf:f bound:f significant:b", lambda t: season.autocorrelation(order_series(t), ["metric"]), _acf_sql()),
    Query("seasonality", "has_seasonality:b has_weekly:b has_monthly:b has_daily:b", lambda t: season.seasonality(t.orders, "o_orderdate", "o_totalprice"),
          f"""WITH a AS ({_acf_sql()}), m AS (SELECT * FROM a WHERE metric = 'price') SELECT bool_or(lag > 0 AND significant) AS has_seasonality,
 bool_or(lag = 7 AND significant) AS has_weekly, bool_or(lag = 30 AND significant) AS has_monthly, (SELECT count(*) > 1 AND coalesce(stddev_samp(v) / avg(v) > 0.1, false) FROM (SELECT avg(o_totalprice) AS v FROM orders GROUP BY hour(o_orderdate)) AS h) AS has_daily FROM m"""),
    Query("daily_pattern", "event_type:s has_daily:b",
          lambda t: season.daily_variation(t.events, ["event_type"], "ts", "value"),
          """WITH h AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2)
 SELECT event_type, count(*) > 1 AND stddev_samp(v) / avg(v) > 0.1 AS has_daily FROM h GROUP BY 1"""),
    Query("weekday_pattern", "metric:s weekday:i offset:f", lambda t: season.weekday_pattern(order_series(t), ["metric"]),
          f"""WITH {_D}, g AS (SELECT metric, avg(value) AS g FROM d GROUP BY 1) SELECT d.metric, isodow(day) - 1 AS weekday, (avg(value) - any_value(g)) * 0.5 AS "offset"
 FROM d JOIN g ON d.metric = g.metric GROUP BY 1, 2"""),
    Query("linear_trend", "metric:s slope:f", lambda t: season.linear_trend(order_series(t), ["metric"]),
          f"WITH {_D}, i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS i FROM d) SELECT metric, regr_slope(value, i) AS slope FROM i GROUP BY 1"),
    Query("decompose", _DEC, daily_parts, f"WITH {_D}, {_decompose_sql(7)} SELECT * FROM dec"),
    Query("decompose_even", _DEC, lambda t: season.decompose(order_series(t), ["metric"], season="monthly"), f"WITH {_D}, {_decompose_sql(12)} SELECT * FROM dec"),
    Query("recompose", "day:d metric:s recomposed:f", recomposed, f"WITH {_D} SELECT day, metric, value AS recomposed FROM d"),
    Query("seasonal_explanation", "day:d metric:s seasonal_impact_percent:f is_anomalous:b",
          lambda t: season.explain_seasonally(daily_parts(t), ["metric"], "series"), _EXPL),
    Query("layers", "day:d metric:s statistical:b seasonal:b sequence:b any_anomaly:b", layered,
          f"""WITH {_STAT}, {_seasonal_sql((7, 12))}, er0 AS (SELECT day, metric, CASE WHEN count(value) OVER w = 14 THEN abs(value - avg(value) OVER w) END AS e FROM d WINDOW w AS (PARTITION BY metric ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
 er AS (SELECT metric, avg(e) + 3 * stddev_pop(e) AS th FROM er0 GROUP BY 1),
 j AS (SELECT st.day, st.metric, coalesce(value_anomaly, false) OR coalesce(trend_anomaly, false) OR coalesce(volatility_anomaly, false) AS statistical,
  seasonal_anomaly AS seasonal, coalesce(e > th, false) AS sequence FROM st JOIN se ON st.day = se.day AND st.metric = se.metric JOIN er ON st.metric = er.metric JOIN er0 ON st.metric = er0.metric AND st.day = er0.day)
 SELECT *, statistical OR seasonal OR sequence AS any_anomaly FROM j"""),
    Query("thresholds", "metric:s gaussian:f percentile:f",
          lambda t: layers.error_threshold(order_series(t), ["metric"], "value").withColumnRenamed("threshold", "gaussian").join(
              layers.error_threshold(order_series(t).withColumnRenamed("value", "e"), ["metric"], "e", method="percentile").withColumnRenamed("threshold", "percentile"), "metric"),
          f"WITH {_D} SELECT metric, avg(value) + 3 * stddev_pop(value) AS gaussian, quantile_cont(value, 0.99) AS percentile FROM d GROUP BY 1"),
]
