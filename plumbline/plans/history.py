"""Registered queries: dates against their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import flags, history, joins, profile_state, sketch_state
from plumbline.plans import flags as flag_plans
from plumbline.plans.registry import Query
from plumbline.plans.sqltext import long_sql
from plumbline.plans.windows import EVENT_SQL, ITEM_COLS, items, sparse_events

_BASE = f"e AS (SELECT CAST(ts AS DATE) AS period, ts, event_id, event_type, value FROM ({EVENT_SQL}) AS s)"
_BY_DATE = f"""{_BASE}, now AS (SELECT period, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
 max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, skewness(value) AS skew, kurtosis(value) AS kurtosis,
 count(*) FILTER (WHERE value = 0) * 100.0 / count(*) AS zeros_pct, count(*) FILTER (WHERE value IS NULL) * 100.0 / count(*) AS nulls_pct FROM e GROUP BY 1)"""
_PAST = """o AS (SELECT *, row_number() OVER (ORDER BY period, ts, event_id) AS i FROM e),
starts AS (SELECT period, min(i) AS s FROM o GROUP BY 1), wins AS (SELECT unnest([7, 14, 30, 90]) AS n),
past AS (SELECT s.period, w.n, o.event_type, o.value FROM starts s, wins w, o WHERE s.s - 1 >= w.n AND o.i BETWEEN s.s - w.n AND s.s - 1)"""
_NUM_SQL = f"""WITH {_BY_DATE}, {_PAST}, h AS (SELECT period, n, avg(value) AS hm, median(value) AS hmed, stddev_samp(value) AS hs, max(value) - min(value) AS hr FROM past GROUP BY 1, 2)
SELECT h.period, 'value' AS "column", n AS "window", mean - hm AS mean_diff, median - hmed AS median_diff, std / greatest(hs, 1e-8) AS std_ratio,
 range / greatest(hr, 1e-8) AS range_ratio, (mean - hm) / greatest(hs, 1e-8) AS zscore FROM h JOIN now ON h.period = now.period"""
_COMBINED_SQL = f"""WITH r AS ({_NUM_SQL}), l AS ({" UNION ALL ".join(f'SELECT period, "window" AS w, {chr(39)}{c}{chr(39)} AS k, {c} AS value FROM r' for c in ("mean_diff", "median_diff", "std_ratio", "range_ratio", "zscore"))}),
z AS (SELECT *, avg(value) OVER (PARTITION BY w, k) AS a, stddev_samp(value) OVER (PARTITION BY w, k) AS s FROM l),
u AS (SELECT * FROM z WHERE s > 0), c AS (SELECT count(DISTINCT (w, k)) AS used FROM u),
g AS (SELECT period, avg(abs((value - a) / s)) AS sc, count(value) AS have FROM u GROUP BY 1)
SELECT period, 'value' AS "column", CASE WHEN have = used THEN sc END AS combined_score, CASE WHEN have = used AND sc > 3 THEN 1 ELSE 0 END AS combined_flag FROM g, c"""


def drifting(t):
    """Events whose types change over the month: a type is renamed in the second half, some are missing."""
    e = F.col("event_type")
    late = F.when((F.dayofmonth("ts") > 15) & (e == "click"), "tap").otherwise(e)
    return t.events.select("ts", "event_id", F.when(F.col("event_id") % 6 != 0, late).alias("event_type"))


_DRIFT = """e AS (SELECT CAST(ts AS DATE) AS period, ts, event_id, 0.0 AS value, CASE WHEN event_id % 6 <> 0 THEN
  CASE WHEN day(ts) > 15 AND event_type = 'click' THEN 'tap' ELSE event_type END END AS event_type FROM events)"""
_JS_SQL = f"""WITH {_DRIFT}, {_PAST}, a AS (SELECT period, coalesce(event_type, '?') AS v, count(*) AS n FROM e GROUP BY 1, 2),
b AS (SELECT period, n AS w, coalesce(event_type, '?') AS v, count(*) AS n FROM past GROUP BY 1, 2, 3), k AS (SELECT DISTINCT period, n AS w FROM past),
ak AS (SELECT k.period, k.w, a.v, a.n, sum(a.n) OVER (PARTITION BY k.period, k.w) AS t FROM k JOIN a ON k.period = a.period),
j AS (SELECT coalesce(ak.period, b.period) AS period, coalesce(ak.w, b.w) AS w, coalesce(ak.v, b.v) AS v, coalesce(ak.n / ak.t, 0) AS p,
  coalesce(b.n / CAST(b.w AS DOUBLE), 0) AS q FROM ak FULL OUTER JOIN b ON ak.period = b.period AND ak.w = b.w AND ak.v = b.v)
SELECT period, 'event_type' AS "column", w AS "window", count(*) FILTER (WHERE p > 0 AND v <> '?') - count(*) FILTER (WHERE q > 0 AND v <> '?') AS unique_diff,
 sum(0.5 * (p * log2(p / (0.5 * (p + q) + 1e-10) + 1e-10) + q * log2(q / (0.5 * (p + q) + 1e-10) + 1e-10))) AS js_distance,
 count(*) FILTER (WHERE p > 0 AND q = 0) AS new_categories FROM j GROUP BY 1, 2, 3"""

_SKETCHED = {"q10": 0.1, "median": 0.5, "q90": 0.9}
RANK_ERROR, DISTINCT_ERROR = 0.02, 0.05


def sketched_years(t):
    """Years merged from the states of days, and whether their quantiles and distinct counts keep their bounds against the exact values."""
    states = sketch_state.period_states(items(t), "l_shipdate", ITEM_COLS, "day").withColumn("period", F.date_trunc("year", "period"))
    facts = sketch_state.finished_states(sketch_state.merged_states(states, ["period", "column"]), ["period", "column"], _SKETCHED)
    months = profile_state.value_state(items(t), "l_shipdate", "month", ITEM_COLS).where("value is not null")
    exact = months.withColumn("period", F.date_trunc("year", "period")).groupBy("period", "column", "value").agg(F.sum("n").alias("n"))
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    kept = [((share(F.col("value") < F.col(q)) <= p + RANK_ERROR) & (share(F.col("value") <= F.col(q)) >= p - RANK_ERROR)).alias(f"{q}_ok") for q, p in _SKETCHED.items()]
    near = (F.abs(F.count(F.lit(1)) - F.max("unique_estimate")) <= DISTINCT_ERROR * F.count(F.lit(1)) + 1).alias("unique_ok")
    checks = exact.join(facts, ["period", "column"]).groupBy("period", "column").agg(*kept, near)
    return facts.join(checks, ["period", "column"], "left")


def sketched_history(t):
    """For each day of events the merged states of the seven days before it."""
    states = sketch_state.period_states(sparse_events(t), "ts", ["value", "user_id"])
    return sketch_state.finished_states(sketch_state.history_states(states, 7), ["period", "column"], {"median": 0.5})


_LONG_ITEMS = f"base AS (SELECT date_trunc('year', l_shipdate) AS period, {', '.join(ITEM_COLS)} FROM lineitem), long AS ({long_sql('base', ['period'], ITEM_COLS)})"
_FACT_COLUMNS = """count(value) AS count, count(*) - count(value) AS missing_count, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
 count(*) FILTER (WHERE value = 0) AS zero_count, count(*) FILTER (WHERE value < 0) AS negative_count"""
_STATE_LAYOUT = "period:d column:s count:i missing_count:i min:f max:f mean:f std:f zero_count:i negative_count:i"

QUERIES = [
    Query("sketch_years", _STATE_LAYOUT + " q10_ok:b median_ok:b q90_ok:b unique_ok:b", sketched_years,
          f"""WITH {_LONG_ITEMS} SELECT period, "column", {_FACT_COLUMNS}, true AS q10_ok, true AS median_ok, true AS q90_ok, true AS unique_ok FROM long GROUP BY 1, 2"""),
    Query("sketch_history", _STATE_LAYOUT, sketched_history,
          f"""WITH base AS (SELECT date_trunc('day', ts) AS period, value, user_id FROM ({EVENT_SQL}) AS e), long AS ({long_sql('base', ['period'], ['value', 'user_id'])}),
 d AS (SELECT DISTINCT period FROM base), h AS (SELECT d.period, "column", value FROM d JOIN long AS l ON l.period < d.period AND l.period >= d.period - INTERVAL 7 DAY)
 SELECT period, "column", {_FACT_COLUMNS} FROM h GROUP BY 1, 2"""),
    Query("date_numeric", "period:d column:s mean:f median:f std:f min:f max:f range:f iqr:f skew:f kurtosis:f zeros_pct:f nulls_pct:f",
          lambda t: history.numeric_by_date(sparse_events(t), "ts", ["value"]), f"WITH {_BY_DATE} SELECT *, 'value' AS \"column\" FROM now"),
    Query("hist_numeric", "period:d column:s window:i mean_diff:f median_diff:f std_ratio:f range_ratio:f zscore:f",
          lambda t: history.numeric_history(sparse_events(t), "ts", "event_id", ["value"]), _NUM_SQL),
    Query("hist_numeric_days", "period:d column:s window:i mean_diff:f std_ratio:f range_ratio:f zscore:f",
          lambda t: history.numeric_history_days(sparse_events(t), "ts", ["value"]),
          f"""WITH {_BY_DATE}, wins AS (SELECT unnest([7, 14, 30, 90]) AS n), h AS (SELECT now.period, n, avg(e.value) AS hm, stddev_samp(e.value) AS hs, max(e.value) - min(e.value) AS hr
 FROM now, wins, e WHERE e.period BETWEEN now.period - CAST(n AS INTEGER) AND now.period - 1 GROUP BY 1, 2)
 SELECT h.period, 'value' AS "column", n AS "window", mean - hm AS mean_diff, std / greatest(hs, 1e-8) AS std_ratio, range / greatest(hr, 1e-8) AS range_ratio,
 (mean - hm) / greatest(hs, 1e-8) AS zscore FROM h JOIN now ON h.period = now.period"""),
    Query("date_categories", "period:d column:s unique_count:i mode:s entropy:f nulls_pct:f",
          lambda t: history.category_by_date(drifting(t), "ts", ["event_type"]),
          f"""WITH {_DRIFT}, c AS (SELECT period, event_type AS v, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY period) AS t,
 row_number() OVER (PARTITION BY period ORDER BY CASE WHEN v IS NULL THEN 1 ELSE 0 END, n DESC, v) AS k FROM c)
 SELECT period, 'event_type' AS "column", count(v) AS unique_count, max(CASE WHEN k = 1 THEN v END) AS mode, -sum(n / t * log2(n / t + 1e-10)) AS entropy,
 coalesce(sum(CASE WHEN v IS NULL THEN n * 100.0 / t END), 0) AS nulls_pct FROM r GROUP BY 1"""),
    Query("js_drift", "period:d column:s window:i unique_diff:i js_distance:f new_categories:i",
          lambda t: history.category_history(drifting(t), "ts", "event_id", ["event_type"]), _JS_SQL),
    Query("align_counts", "value:s n_a:i n_b:i",
          lambda t: joins.align_counts(*[t.orders.where(c).groupBy(F.col("o_custkey").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
                                         for c in ("o_orderdate < '1996-01-01'", "o_orderdate >= '2001-01-01'")], ["value"]),
          """SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS n_a,
 count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-01-01') AS n_b FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1"""),
    Query("new_categories", "o_custkey:i",
          lambda t: joins.new_keys(t.orders.where("o_orderdate >= '2001-01-01'"), t.orders.where("o_orderdate < '1998-01-01'"), ["o_custkey"]),
          """SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')"""),
    Query("attach_profile", "event_id:i mean:f nulls_pct:f",
          lambda t: history.attach_to_rows(sparse_events(t), history.numeric_by_date(sparse_events(t), "ts", ["value"]), "ts"),
          f"WITH {_BY_DATE} SELECT event_id, mean, nulls_pct FROM e JOIN now ON e.period = now.period"),
    Query("combined_score", "period:d column:s combined_score:f combined_flag:i",
          lambda t: flags.combined_scores(flag_plans._history_long(t)), _COMBINED_SQL),
]
