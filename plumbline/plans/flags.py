"""Registered queries: flags and scores of periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import flags, history, rolling
from plumbline.plans.features import _rolling_sql, order_days
from plumbline.plans.registry import Query
from plumbline.plans.windows import sparse_events

_M = {  # metric name -> SQL aggregate over the month of line items
    "quantity_mean": "avg(l_quantity)", "quantity_std": "stddev_samp(l_quantity)", "price_mean": "avg(l_extendedprice)",
    "price_max": "max(l_extendedprice)", "row_count": "CAST(count(*) AS DOUBLE)", "discount_mean": "avg(l_discount)",
    "zero_tax_pct": "count(*) FILTER (WHERE l_tax = 0) * 100.0 / count(*)", "corr_quantity_price": "corr(l_quantity, l_extendedprice)",
    "sparse_mean": "CASE WHEN month(min(l_shipdate)) <= 6 THEN avg(l_tax) END",
}


def item_months(t):
    """Month metrics of line items as (period, metric, value); one of them is missing half the time."""
    c = F.col
    wide = t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").alias("period")).agg(
        F.avg("l_quantity").alias("quantity_mean"), F.stddev_samp("l_quantity").alias("quantity_std"), F.avg("l_extendedprice").alias("price_mean"),
        F.max("l_extendedprice").alias("price_max"), F.count(F.lit(1)).cast("double").alias("row_count"), F.avg("l_discount").alias("discount_mean"),
        (F.count_if(c("l_tax") == 0) * 100.0 / F.count(F.lit(1))).alias("zero_tax_pct"), F.corr("l_quantity", "l_extendedprice").alias("corr_quantity_price"),
        F.when(F.month(F.min("l_shipdate")) <= 6, F.avg("l_tax")).alias("sparse_mean"),
    )
    return wide.unpivot(["period"], list(_M), "metric", "value")


MONTHS_SQL = (f"SELECT period, unnest({list(_M)}) AS metric, unnest([{', '.join(_M)}]) AS value "
              f"FROM (SELECT date_trunc('month', l_shipdate) AS period, {', '.join(f'{e} AS {n}' for n, e in _M.items())} FROM lineitem GROUP BY 1) AS wide")

_FLAGS_CTE = f"""m AS ({MONTHS_SQL}), np AS (SELECT count(DISTINCT period) AS k FROM m),
zs AS (SELECT metric, avg(value) AS a, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM m, np GROUP BY metric, k HAVING 1 - count(value) / CAST(k AS DOUBLE) <= 0.3),
z AS (SELECT period, m.metric, abs((value - a) / s) AS score FROM m JOIN zs ON m.metric = zs.metric WHERE s > 0),
zf AS (SELECT *, CASE WHEN score > 3 THEN 1 ELSE 0 END AS flag FROM z),
qf AS (SELECT period, m.metric, CASE WHEN value IS NOT NULL THEN greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1), 0) / (q3 - q1) END AS score,
  CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END AS flag FROM m JOIN zs ON m.metric = zs.metric WHERE q3 - q1 > 0),
w AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur,
  last_value(value IGNORE NULLS) OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv FROM m
  WHERE contains(metric, '_pct') OR contains(metric, '_mean') OR contains(metric, '_total') OR contains(metric, '_count') OR contains(metric, '_ratio')),
ch AS (SELECT *, (cur - prv) / nullif(prv, 0) AS change FROM w),
cs AS (SELECT metric, avg(change) AS a, stddev_samp(change) AS s FROM ch WHERE metric IN (SELECT metric FROM zs) GROUP BY 1),
rf AS (SELECT period, ch.metric, abs((change - a) / s) AS score, CASE WHEN abs((change - a) / s) > 3 THEN 1 ELSE 0 END AS flag FROM ch JOIN cs ON ch.metric = cs.metric WHERE s > 0),
cf AS (SELECT * FROM zf WHERE starts_with(metric, 'corr_')),
af AS (SELECT * FROM zf UNION ALL SELECT * FROM qf UNION ALL SELECT * FROM rf UNION ALL SELECT * FROM cf),
tot AS (SELECT p.period, coalesce(sum(flag), 0) AS total, coalesce(sum(coalesce(score, 0) * flag), 0) AS s FROM (SELECT DISTINCT period FROM m) p
  LEFT JOIN af ON p.period = af.period GROUP BY 1)"""

_FLAG = "period:d metric:s score:f flag:i"
_FLAT_CTE = "WITH r AS (" + _rolling_sql() + ")"


def _history_long(t):
    return history.history_features(history.numeric_history(sparse_events(t), "ts", "event_id", ["value"]))


QUERIES = [
    Query("zscore_windows", _FLAG, lambda t: flags.zscore_flags(item_months(t)), f"WITH {_FLAGS_CTE} SELECT * FROM zf"),
    Query("iqr_flags", _FLAG, lambda t: flags.iqr_flags(item_months(t)), f"WITH {_FLAGS_CTE} SELECT * FROM qf"),
    Query("rate_flags", _FLAG, lambda t: flags.rate_flags(item_months(t)), f"WITH {_FLAGS_CTE} SELECT * FROM rf"),
    Query("correlation_flags", _FLAG, lambda t: flags.correlation_flags(item_months(t)), f"WITH {_FLAGS_CTE} SELECT * FROM cf"),
    Query("anomaly_score", "period:d total_anomalies:i anomaly_score:f is_anomaly:i", lambda t: flags.score_periods(item_months(t)),
          f"""WITH {_FLAGS_CTE} SELECT period, total AS total_anomalies, s / (SELECT CASE WHEN max(s) > 0 THEN max(s) / 10 ELSE 1 END FROM tot) AS anomaly_score,
 CASE WHEN total >= 3 THEN 1 ELSE 0 END AS is_anomaly FROM tot"""),
    Query("flag_count", "period:d total_anomalies:i anomaly_score:f is_anomaly:i",
          lambda t: flags.combine_flags(item_months(t), flags.all_flags(item_months(t)), weighted=False),
          f"WITH {_FLAGS_CTE} SELECT period, total AS total_anomalies, total AS anomaly_score, CASE WHEN total >= 3 THEN 1 ELSE 0 END AS is_anomaly FROM tot"),
    Query("zscore_metric_flags", "period:d metric:s flag:i",
          lambda t: flags.zscore_metric_flags(rolling.rolling_metrics(rolling.rolling_features(order_days(t)))),
          f"""{_FLAT_CTE} SELECT period, metric || '_anomaly_' || "window" || 'd' AS metric, CASE WHEN abs(zscore) > 3 THEN 1 ELSE 0 END AS flag FROM r"""),
    Query("widest_zscore", "period:d metric:s max_zscore:f any_anomaly:i", lambda t: flags.widest_zscore(rolling.rolling_features(order_days(t))),
          f"""{_FLAT_CTE} SELECT period, metric, max(abs(zscore)) AS max_zscore, CASE WHEN max(abs(zscore)) > 3 THEN 1 ELSE 0 END AS any_anomaly FROM r GROUP BY 1, 2"""),
    Query("target_flags", "period:d target:s any_anomaly:i anomaly_count:i",
          lambda t: flags.target_flags(rolling.rolling_features(order_days(t)).select("period", F.col("metric").alias("target"), F.col("anomaly").alias("flag"))),
          f"{_FLAT_CTE} SELECT period, metric AS target, max(anomaly) AS any_anomaly, sum(anomaly) AS anomaly_count FROM r GROUP BY 1, 2"),
]
