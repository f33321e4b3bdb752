"""Registered queries: joins, panels, rolling and lag features, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cleaning, joins, panel, rolling
from plumbline.plans.registry import Query
from plumbline.plans.windows import EVENT_SQL, sparse_events


def order_days(t):
    """Number and mean price of orders per day, as (period, metric, value)."""
    daily = t.orders.groupBy(F.date_trunc("day", "o_orderdate").alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    return daily.unpivot(["period"], ["orders", "price"], "metric", "value")


ORDER_DAYS_SQL = """SELECT date_trunc('day', o_orderdate) AS period, 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1
UNION ALL SELECT date_trunc('day', o_orderdate), 'price', avg(o_totalprice) FROM orders GROUP BY 1"""


def _rolling_sql() -> str:
    parts = []
    for w in (7, 14, 30, 90):
        over = f"OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"""SELECT period, metric, {w} AS "window", value, count(value) {over} AS c, avg(value) {over} AS m, stddev_samp(value) {over} AS s,
 min(value) {over} AS mn, max(value) {over} AS mx, regr_slope(value, i) {over} AS tr FROM i""")
    return f"""WITH d AS ({ORDER_DAYS_SQL}), i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period) AS i FROM d),
 r AS ({' UNION ALL '.join(parts)}), f AS (SELECT period, metric, "window", value, CASE WHEN c = "window" THEN m END AS mean, CASE WHEN c = "window" THEN s END AS std,
   CASE WHEN c = "window" THEN mn END AS min, CASE WHEN c = "window" THEN mx END AS max, CASE WHEN c = "window" THEN tr END AS trend FROM r)
SELECT *, (value - mean) / (std + 1e-8) AS zscore, CASE WHEN abs((value - mean) / (std + 1e-8)) > 3 THEN 1 ELSE 0 END AS anomaly,
 value - mean AS diff, value / (mean + 1e-8) AS ratio FROM f"""


_ROLL = "period:d metric:s window:i"


def filled_panel(t):
    return panel.gap_fill(sparse_events(t), "user_id", "ts", ["value"], "event_id")


FILL_SQL = f"""WITH e AS ({EVENT_SQL}), r AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, value FROM e),
u AS (SELECT user_id FROM r GROUP BY 1 HAVING count(*) > 1),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY)) AS DATE) AS day),
spine AS (SELECT user_id, day FROM u, days),
g AS (SELECT user_id, day, arg_max(value, (ts, event_id)) AS lv, arg_min(value, (ts, event_id)) AS fv FROM r WHERE value IS NOT NULL GROUP BY 1, 2),
f AS (SELECT s.user_id, s.day, coalesce(last_value(lv IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   first_value(fv IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill
   FROM spine s LEFT JOIN g ON s.user_id = g.user_id AND s.day = g.day),
filled AS (SELECT f.user_id, f.day, r.event_id, coalesce(r.value, f.fill) AS value FROM f LEFT JOIN r ON f.user_id = r.user_id AND f.day = r.day)"""

_OVER = "PARTITION BY user_id ORDER BY day, event_id"
_DERIVED_SQL = f"""{FILL_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, lag(value) OVER ({_OVER}) AS p,
 avg(value) OVER ({_OVER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m, stddev_samp(value) OVER ({_OVER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s FROM filled)
SELECT user_id, day, event_id, value, isodow(day) - 1 AS day_of_week, day(day) AS day_of_month, month(day) AS month,
 CASE WHEN day = last_day(day) THEN 1 ELSE 0 END AS is_month_end, CASE WHEN n >= 7 THEN m END AS value_7d_mean, CASE WHEN n >= 7 THEN s END AS value_7d_std,
 CASE WHEN n >= 7 THEN coalesce(value - p, 0) END AS value_change,
 CASE WHEN n >= 7 THEN CASE WHEN p IS NULL THEN 0 ELSE (value - p) / nullif(p, 0) END END AS value_pct_change,
 CASE WHEN n >= 7 THEN (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END END AS value_zscore FROM w"""


def denormalised(t):
    who = joins.left_with_suffix(t.orders.withColumnRenamed("o_custkey", "custkey"),
                                 t.customer.withColumnRenamed("c_custkey", "custkey").withColumn("o_orderstatus", F.lit("c")), ["custkey"], "_customer")
    return joins.left_with_suffix(t.lineitem.withColumnRenamed("l_orderkey", "orderkey"), who.withColumnRenamed("o_orderkey", "orderkey"),
                                  ["orderkey"], "_order")


def messy(t):
    """Events with text numbers, comma lists, an empty column and a category."""
    return t.events.select("event_id", "event_type", F.col("value").cast("string").alias("number_text"),
                           F.concat_ws(",", F.col("user_id"), F.col("value")).alias("list_text"),
                           F.lit(None).cast("string").alias("empty"), "props")


def gappy_days(t):
    m = order_days(t).where("metric = 'price'")
    return m.withColumn("value", F.when(F.dayofyear("period") % 9 > 1, F.col("value")))


_GAPPY_SQL = f"SELECT period, metric, CASE WHEN dayofyear(period) % 9 > 1 THEN value END AS value FROM ({ORDER_DAYS_SQL}) AS d WHERE metric = 'price'"
_INTERP_SQL = f"""WITH g AS ({_GAPPY_SQL}), i AS (SELECT *, row_number() OVER (ORDER BY period) AS i FROM g),
p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(value IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS qi, first_value(value IGNORE NULLS) OVER a AS qv FROM i
  WINDOW b AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT period, metric, CASE WHEN value IS NOT NULL THEN value WHEN qv IS NULL THEN pv ELSE pv + (qv - pv) * (i - pi) / nullif(qi - pi, 0) END AS value FROM p)"""

SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scaled(t, how):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = t.lineitem.select(*keys, *SCALE_COLS).withColumn("flat", F.lit(5.0))
    return cleaning.scale(df, [*SCALE_COLS, "flat"], how)


def _scale_sql(low, width):
    cols = ", ".join(f"({c} - {low(c)} OVER ()) / ({width(c)}) AS {c}" for c in SCALE_COLS)
    return f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {cols}, 0.0 AS flat FROM lineitem"


_SCALE = "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f flat:f"

_TARGETED = """m AS (SELECT CAST(o_orderdate AS DATE) AS period, unnest(['price_mean', 'price_max', 'orders_count']) AS metric,
 unnest([avg(CAST(o_totalprice AS DOUBLE)), max(CAST(o_totalprice AS DOUBLE)), CAST(count(*) AS DOUBLE)]) AS value FROM orders GROUP BY 1)"""


def _daily(t):
    wide = t.orders.groupBy(F.to_date("o_orderdate").alias("period")).agg(
        F.avg(F.col("o_totalprice").cast("double")).alias("price_mean"), F.max(F.col("o_totalprice").cast("double")).alias("price_max"), F.count(F.lit(1)).cast("double").alias("orders_count"))
    return wide.unpivot(["period"], ["price_mean", "price_max", "orders_count"], "metric", "value")


QUERIES = [
    Query("target_metrics", "period:d metric:s value:f target:s", lambda t: cleaning.target_metrics(_daily(t), ["price"]),
          f"WITH {_TARGETED} SELECT period, metric, value, 'price' AS target FROM m WHERE starts_with(metric, 'price_')"),
    Query("drop_present", "c_custkey:i c_nationkey:i", lambda t: cleaning.drop_present(t.customer, ["c_name", "not_there", "c_acctbal", "c_mktsegment"]),
          "SELECT c_custkey, c_nationkey FROM customer"),
    Query("anomaly_rows", "o_orderkey:i o_custkey:i", lambda t: cleaning.anomaly_rows(t.orders, t.orders.where("o_totalprice > 300000").select("o_custkey"), ["o_custkey"], ["o_orderkey"], 25),
          "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) ORDER BY o_orderkey LIMIT 25"),
    Query("model_matrix", "event_id:i value:f inverse:f", lambda t: cleaning.model_matrix(t.events.select("event_id", "value", F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).when(
        F.col("event_id") % 5 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 != 2, F.col("value")).alias("inverse")), ["value", "inverse"]),
          "SELECT event_id, coalesce(value, 0) AS value, CASE event_id % 5 WHEN 0 THEN 1e10 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE coalesce(value, 0) END AS inverse FROM events"),
    Query("derive_aggregate", "department:s salary_category:s total_salary:g avg_age:f employee_count:i",
          lambda t: t.orders.select(
              F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("full_name"), F.col("o_orderpriority").alias("department"),
              F.col("o_totalprice").alias("salary"), F.month("o_orderdate").alias("age"),
              cleaning.banded(F.col("o_totalprice"), [(70000, "High"), (50000, "Medium")], "Low").alias("salary_category"),
          ).groupBy("department", "salary_category").agg(
              F.sum("salary").alias("total_salary"), F.avg("age").alias("avg_age"), F.count(F.lit(1)).alias("employee_count")),
          """SELECT o_orderpriority AS department, CASE WHEN o_totalprice > 70000 THEN 'High' WHEN o_totalprice > 50000 THEN 'Medium' ELSE 'Low' END AS salary_category,
 sum(o_totalprice) AS total_salary, avg(month(o_orderdate)) AS avg_age, count(*) AS employee_count FROM orders GROUP BY 1, 2"""),
    Query("denormalise", "orderkey:i l_linenumber:i l_partkey:i l_suppkey:i custkey:i o_orderstatus:s o_orderstatus_customer:s c_mktsegment:s o_totalprice:g", denormalised,
          """SELECT l_orderkey AS orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS custkey, o_orderstatus, CASE WHEN c_custkey IS NOT NULL THEN 'c' END AS o_orderstatus_customer,
 c_mktsegment, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"""),
    Query("gap_fill", "user_id:i day:d event_id:i value:f", filled_panel, f"{FILL_SQL} SELECT * FROM filled"),
    Query("long_series", "user_id:i events:i",
          lambda t: panel.keep_long_series(t.events, "user_id", "ts", 28).groupBy("user_id").agg(F.count(F.lit(1)).alias("events")),
          "SELECT user_id, count(*) AS events FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 28"),
    Query("derived_features", "user_id:i day:d event_id:i value:f day_of_week:i day_of_month:i month:i is_month_end:i value_7d_mean:f value_7d_std:f "
                              "value_change:f value_pct_change:f value_zscore:f",
          lambda t: panel.derived_features(filled_panel(t), "user_id", "day", "value", "event_id"), _DERIVED_SQL),
    Query("interpolate", "period:d metric:s value:f", lambda t: panel.interpolate(gappy_days(t), ["metric"], "period"),
          f"{_INTERP_SQL} SELECT * FROM f"),
    Query("positive_series", "period:d metric:s value:f",
          lambda t: cleaning.positive_for_decomposition(gappy_days(t).withColumn("value", F.col("value") - 150000), ["metric"], "period"),
          f"""{_INTERP_SQL}, z AS (SELECT period, metric, coalesce(value, last_value(value IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(value IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - 150000 AS value FROM f),
 q AS (SELECT quantile_cont(value, 0.01) AS floor FROM z WHERE value > 0)
 SELECT period, metric, CASE WHEN value <= 0 THEN floor ELSE value END AS value FROM z, q"""),
    Query("rolling", f"{_ROLL} mean:f std:f min:f max:f zscore:f anomaly:i", lambda t: rolling.rolling_features(order_days(t)), _rolling_sql()),
    Query("rolling_slope", f"{_ROLL} trend:f diff:f ratio:f", lambda t: rolling.rolling_features(order_days(t)), _rolling_sql()),
    Query("rolling_flat_windows", "metric:s present:i total:g",
          lambda t: rolling.rolling_metrics(rolling.rolling_features(order_days(t))).groupBy("metric").agg(
              F.count("value").alias("present"), F.sum("value").alias("total")),
          "WITH x AS (" + _rolling_sql() + ") " + " UNION ALL ".join(
              f"SELECT metric || '_{n.format(w)}' AS metric, count({c}) AS present, sum({c}) AS total FROM x WHERE \"window\" = {w} GROUP BY 1"
              for w in (7, 14, 30, 90)
              for n, c in [("rolling_{}d_mean", "mean"), ("rolling_{}d_std", "std"), ("rolling_{}d_min", "min"), ("rolling_{}d_max", "max"), ("zscore_{}d", "zscore"),
                           ("anomaly_{}d", "anomaly"), ("trend_{}d", "trend"), ("diff_{}d", "diff"), ("ratio_{}d", "ratio")])),
    Query("rolling_flat", "metric:s present:i least:f most:f",
          lambda t: rolling.rolling_metrics(rolling.rolling_features(order_days(t))).groupBy("metric").agg(
              F.count("value").alias("present"), F.min("value").alias("least"), F.max("value").alias("most")),
          "WITH x AS (" + _rolling_sql() + ") " + " UNION ALL ".join(
              f"SELECT metric || '_{n.format(w)}' AS metric, count({c}) AS present, min({c}) AS least, max({c}) AS most FROM x WHERE \"window\" = {w} GROUP BY 1"
              for w in (7, 14, 30, 90)
              for n, c in [("rolling_{}d_mean", "mean"), ("rolling_{}d_std", "std"), ("rolling_{}d_min", "min"), ("rolling_{}d_max", "max"), ("zscore_{}d", "zscore"),
                           ("anomaly_{}d", "anomaly"), ("trend_{}d", "trend"), ("diff_{}d", "diff"), ("ratio_{}d", "ratio")])),
    Query("lags", "period:d metric:s lag:i lagged:f diff:f", lambda t: rolling.lag_features(order_days(t)),
          f"WITH d AS ({ORDER_DAYS_SQL}) " + " UNION ALL ".join(
              f"""SELECT period, metric, {k} AS lag, coalesce(lag(value, {k}) OVER (PARTITION BY metric ORDER BY period), 0) AS lagged,
 coalesce(value - lag(value, {k}) OVER (PARTITION BY metric ORDER BY period), 0) AS diff FROM d""" for k in (1, 2, 3))),
    Query("calendar", "o_orderkey:i day_of_week:i day_of_month:i month:i is_month_end:i is_quarter_end:i",
          lambda t: rolling.calendar_features(t.orders, "o_orderdate"),
          """SELECT o_orderkey, isodow(o_orderdate) - 1 AS day_of_week, day(o_orderdate) AS day_of_month, month(o_orderdate) AS month,
 CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN 1 ELSE 0 END AS is_month_end,
 CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) AND month(o_orderdate) % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end FROM orders"""),
    Query("dtype_repair", "event_id:i number_text:f list_text:f props:s", lambda t: cleaning.repair_types(messy(t)),
          "SELECT event_id, value AS number_text, CAST(user_id AS DOUBLE) AS list_text, props FROM events"),
    Query("null_policy", "event_id:i value:f event_type:s",
          lambda t: cleaning.fill_for_models(sparse_events(t).withColumn("event_type", F.when(F.col("event_id") % 4 > 0, F.col("event_type")))
                                             .withColumn("rare", F.when(F.col("event_id") % 50 == 0, F.lit(1.0))), ("ts",)),
          f"SELECT event_id, coalesce(value, 0) AS value, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'unknown' END AS event_type FROM ({EVENT_SQL}) AS e"),
    Query("scale_standard", _SCALE, lambda t: _scaled(t, "standard"),
          _scale_sql(lambda c: f"avg({c})", lambda c: f"stddev_pop({c}) OVER ()")),
    Query("scale_minmax", _SCALE, lambda t: _scaled(t, "minmax"),
          _scale_sql(lambda c: f"min({c})", lambda c: f"max({c}) OVER () - min({c}) OVER ()")),
    Query("date_split", "part:s periods:i first:d last:d",
          lambda t: _split(t),
          f"""WITH d AS ({ORDER_DAYS_SQL}), x AS (SELECT DISTINCT period FROM d), a AS (SELECT period FROM x WHERE period < TIMESTAMP '2000-01-01' ORDER BY period DESC LIMIT 365)
 SELECT 'train' AS part, count(*) AS periods, min(period) AS first, max(period) AS last FROM a
 UNION ALL SELECT 'test', count(*), min(period), max(period) FROM x WHERE period >= TIMESTAMP '2000-01-01'"""),
    Query("target_dates", "period:d metric:s value:f", lambda t: cleaning.mark_targets(order_days(t), "period").where("is_target"),
          f"SELECT * FROM ({ORDER_DAYS_SQL}) AS d WHERE period IN (SELECT DISTINCT date_trunc('day', o_orderdate) FROM orders ORDER BY 1 DESC LIMIT 7)"),
]


def _split(t):
    train, test = cleaning.split_by_date(order_days(t), "period", "2000-01-01", keep_train=365)
    facts = lambda df, part: df.agg(F.lit(part).alias("part"), F.count_distinct("period").alias("periods"),
                                    F.min("period").alias("first"), F.max("period").alias("last"))
    return facts(train, "train").unionByName(facts(test, "test"))
