"""Registered queries: fusion of detectors, severities, summaries, whole detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import density, flags, fusion, sequence
from plumbline.plans import detection
from plumbline.plans.density import _MEASURED, FEATURES, _combine, measured_events
from plumbline.plans.features import FILL_SQL
from plumbline.plans.flags import _FLAGS_CTE, item_months
from plumbline.plans.registry import Query
from plumbline.sources import writers
from plumbline.plans.sequences import SCALED_SQL, scaled_months
from plumbline.plans.windows import EVENT_SQL

_DETECTORS = f"""{_MEASURED}, a AS (SELECT event_id, least(1, (abs(value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-8)
  + abs(k - avg(k) OVER ()) / (stddev_pop(k) OVER () + 1e-8)) / 2 / 10) AS score FROM r),
b0 AS (SELECT event_id, sqrt(((value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-8)) ** 2 + ((k - avg(k) OVER ()) / (stddev_pop(k) OVER () + 1e-8)) ** 2) AS z FROM r),
b AS (SELECT event_id, z / (max(z) OVER () + 1e-8) AS score FROM b0),
fa AS (SELECT *, CASE WHEN score >= 0.2 THEN 1 ELSE 0 END AS flag FROM a), fb AS (SELECT *, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS flag FROM b)"""


def two_detectors(t):
    src = density.mean_distance(measured_events(t), FEATURES).select("event_id", "score")
    other = density.z_norm(measured_events(t), FEATURES).select("event_id", "score")
    mark = lambda df, limit: df.withColumn("flag", (F.col("score") >= limit).cast("int"))
    return mark(src, 0.2), mark(other, 0.35)


def graded(t):
    """Month scores: prediction error against tail scores brought to a comparable scale."""
    a, b = month_detectors(t)
    return fusion.severity(fusion.consensus(a, b, ["period"]))


def month_detectors(t):
    seq = sequence.sequence_scores(scaled_months(t)).select("period", "score")
    den = flags.score_periods(item_months(t)).select("period", (F.col("anomaly_score") / 10).alias("score"))
    return seq, den


def _graded_sql():
    return f"""WITH {_FLAGS_CTE}, ff AS (SELECT period, metric, coalesce(value, 0) AS value FROM m),
zz AS (SELECT period, metric, coalesce((value - avg(value) OVER (PARTITION BY metric)) / nullif(stddev_pop(value) OVER (PARTITION BY metric), 0), 0) AS value FROM ff),
pp AS (SELECT period, metric, CASE WHEN count(*) OVER p14 = 14 THEN (value - avg(value) OVER p14) ** 2 END AS e FROM zz WINDOW p14 AS (PARTITION BY metric ORDER BY period ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
er AS (SELECT period, avg(e) AS error FROM pp GROUP BY 1), lim AS (SELECT quantile_cont(error, 0.95) AS l, avg(error) AS a FROM er WHERE error IS NOT NULL),
sc AS (SELECT er.period, coalesce(error / l, a / l) AS s, tot.s / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1 END FROM tot) AS d FROM er JOIN tot ON er.period = tot.period, lim),
co AS (SELECT period, s AS sequence_score, d AS density_score, 0.6 * s + 0.4 * d AS consensus_score, s >= 1 AS sequence_anomaly, d >= 0.7 AS density_anomaly,
  0.6 * s + 0.4 * d >= 0.75 AS consensus_anomaly, s >= 1 OR d >= 0.7 AS combined_anomaly FROM sc),
gr AS (SELECT *, CASE WHEN consensus_anomaly THEN CASE WHEN sequence_score >= 1.5 AND density_score >= 0.8 THEN 'CRITICAL' WHEN consensus_score >= 0.8 THEN 'HIGH'
  WHEN consensus_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END END AS severity FROM co)"""


def user_flags(t):
    """Events flagged per user when far above the user's own mean."""
    stats = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return t.events.join(stats, "user_id").select("user_id", F.col("event_type").alias("column"), (F.col("value") > F.col("m") + 2 * F.col("s")).cast("int").alias("flag"))


_USER_FLAGS = """u AS (SELECT user_id, event_type, CASE WHEN value > avg(value) OVER (PARTITION BY user_id) + 2 * stddev_pop(value) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS flag FROM events),
g AS (SELECT user_id, sum(flag) AS a FROM u GROUP BY 1), c AS (SELECT user_id, event_type, sum(flag) AS a FROM u GROUP BY 1, 2)"""


def _detect_sql() -> str:
    tail = lambda src: f"""SELECT metric, value, -ln(sum(c) OVER (PARTITION BY metric ORDER BY value) / sum(c) OVER (PARTITION BY metric)) AS l,
 -ln(sum(c) OVER (PARTITION BY metric ORDER BY value DESC) / sum(c) OVER (PARTITION BY metric)) AS r FROM (SELECT metric, value, count(*) AS c FROM {src} GROUP BY 1, 2) AS q"""  # noqa: E731
    past = "OVER (PARTITION BY metric ORDER BY period ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
    errs = lambda src: f"SELECT period, avg(e) AS error FROM (SELECT period, CASE WHEN count(*) {past} = 14 THEN (value - avg(value) {past}) ** 2 END AS e FROM {src}) AS q GROUP BY 1"
    return f"""WITH {SCALED_SQL}, tg AS (SELECT DISTINCT period FROM z ORDER BY 1 DESC LIMIT 7), tr AS (SELECT * FROM z WHERE period NOT IN (SELECT period FROM tg)),
ea AS ({errs('z')}), et AS ({errs('tr')}), lim AS (SELECT quantile_cont(error, 0.95) AS lq, avg(error) AS la FROM et WHERE error IS NOT NULL),
sk AS (SELECT metric, coalesce(skewness(value), 0) AS s FROM z GROUP BY 1), sk1 AS (SELECT metric, coalesce(skewness(value), 0) AS s FROM tr GROUP BY 1), t AS ({tail('z')}), t1 AS ({tail('tr')}),
ds AS (SELECT period, sum({_combine('ecod')}) AS d FROM z JOIN t ON z.metric = t.metric AND z.value = t.value JOIN sk ON z.metric = sk.metric GROUP BY 1),
dt AS (SELECT period, sum({_combine('ecod')}) AS d FROM tr JOIN t1 ON tr.metric = t1.metric AND tr.value = t1.value JOIN sk1 ON tr.metric = sk1.metric GROUP BY 1),
dl AS (SELECT quantile_cont(d, 0.98) AS dl FROM dt),
x AS (SELECT ea.period, coalesce(error / lq, la / lq) AS s, d, dl FROM ea JOIN ds ON ea.period = ds.period, lim, dl)
SELECT period, period IN (SELECT period FROM tg) AS is_target, s AS sequence_score, d AS density_score, 0.6 * s + 0.4 * d AS consensus_score, s >= 1 AS sequence_anomaly,
 d >= dl AS density_anomaly, 0.6 * s + 0.4 * d >= 0.75 AS consensus_anomaly,
 CASE WHEN 0.6 * s + 0.4 * d >= 0.75 THEN CASE WHEN s >= 1.5 AND d >= 0.8 THEN 'CRITICAL' WHEN 0.6 * s + 0.4 * d >= 0.8 THEN 'HIGH' WHEN 0.6 * s + 0.4 * d >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END END AS severity FROM x"""


def _panel_sql() -> str:
    past = "OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    tail = lambda where: f"""SELECT value, -ln(sum(c) OVER (ORDER BY value) / sum(c) OVER ()) AS l, -ln(sum(c) OVER (ORDER BY value DESC) / sum(c) OVER ()) AS r,
 s FROM (SELECT value, count(*) AS c FROM d {where} GROUP BY 1) AS q, (SELECT coalesce(skewness(value), 0) AS s FROM d {where}) AS k"""  # noqa: E731
    limits = " UNION ALL ".join(f"SELECT {i} AS fold, quantile_cont({_combine('ecod')}, 0.99) AS th FROM d JOIN ({tail(f'WHERE fold <> {i}')}) AS t USING (value) WHERE fold <> {i}"
                                for i in range(5))
    fill = FILL_SQL.replace(EVENT_SQL, "SELECT * FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 20)")
    return f"""{fill}, d AS (SELECT user_id, day, avg(value) AS value, date_diff('day', DATE '1970-01-01', day) % 5 AS fold FROM filled GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, avg(value) OVER (PARTITION BY user_id) AS gm, stddev_pop(value) OVER (PARTITION BY user_id) AS gs,
  avg(value) {past} AS pm, stddev_pop(value) {past} AS ps FROM d), b AS (SELECT *, CASE WHEN i >= 7 THEN ps END AS vol FROM a),
c AS (SELECT *, avg(vol) {past} AS vm, stddev_pop(vol) {past} AS vs FROM b),
fd AS (SELECT user_id, day, value, coalesce(abs(value - pm), 0) AS first_score FROM c WHERE coalesce(abs(value - gm) > 2 * gs, false) OR coalesce(i >= 7 AND abs(value - pm) > 2 * ps, false)
  OR coalesce(i >= 14 AND abs(vol - vm) > 2 * vs, false)),
t AS ({tail('')}), lim AS ({limits}), gd AS (SELECT user_id, day, {_combine('ecod')} AS second_score, fold FROM d JOIN t USING (value))
SELECT fd.user_id, fd.day, fd.value, first_score, second_score FROM fd JOIN gd ON fd.user_id = gd.user_id AND fd.day = gd.day JOIN lim ON gd.fold = lim.fold WHERE second_score > th"""


_CONS = "sequence_score:f density_score:f consensus_score:f sequence_anomaly:b density_anomaly:b consensus_anomaly:b"
QUERIES = [
    Query("fuse_union", "event_id:i", lambda t: fusion.union(*two_detectors(t), ["event_id"]),
          f"WITH {_DETECTORS} SELECT event_id FROM fa WHERE flag = 1 UNION SELECT event_id FROM fb WHERE flag = 1"),
    Query("fuse_intersect", "event_id:i", lambda t: fusion.intersection(*two_detectors(t), ["event_id"]),
          f"WITH {_DETECTORS} SELECT event_id FROM fa WHERE flag = 1 INTERSECT SELECT event_id FROM fb WHERE flag = 1"),
    Query("fuse_weighted", "event_id:i score:f threshold:f flag:i", lambda t: fusion.weighted(*two_detectors(t), ["event_id"]),
          f"""WITH {_DETECTORS}, j AS (SELECT a.event_id, a.score AS x, b.score AS y FROM a JOIN b ON a.event_id = b.event_id),
 s AS (SELECT event_id, ((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-10) + (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER () + 1e-10)) / 2 AS score FROM j),
 l AS (SELECT quantile_cont(score, 0.99) AS threshold FROM s) SELECT event_id, score, threshold, CASE WHEN score > threshold THEN 1 ELSE 0 END AS flag FROM s, l"""),
    Query("consensus_rows", "event_id:i value:f first_score:f second_score:f",
          lambda t: fusion.consensus_rows(t.events, *two_detectors(t), ["event_id"], ["value"]),
          f"WITH {_DETECTORS} SELECT fa.event_id, value, fa.score AS first_score, fb.score AS second_score FROM fa JOIN fb ON fa.event_id = fb.event_id JOIN events e ON fa.event_id = e.event_id WHERE fa.flag = 1 AND fb.flag = 1"),
    Query("consensus", f"period:d {_CONS} combined_anomaly:b", graded, f"{_graded_sql()} SELECT * FROM gr"),
    Query("severity", "period:d consensus_anomaly:b severity:s", graded, f"{_graded_sql()} SELECT * FROM gr"),
    Query("severity_summary", "rows:i total_anomalies:i anomaly_rate:f critical_count:i high_count:i medium_count:i low_count:i",
          lambda t: fusion.severity_summary(graded(t)),
          f"""{_graded_sql()} SELECT count(*) AS rows, count(*) FILTER (WHERE consensus_anomaly) AS total_anomalies, avg(CASE WHEN consensus_anomaly THEN 1.0 ELSE 0.0 END) AS anomaly_rate,
 {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_count" for s in fusion.SEVERITIES)} FROM gr"""),
    Query("score_statistics", "score:s min:f max:f mean:f std:f", lambda t: fusion.score_statistics(graded(t), ["sequence_score", "density_score", "consensus_score"]),
          f"{_graded_sql()} " + " UNION ALL ".join(f"SELECT '{c}' AS score, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_pop({c}) AS std FROM gr"
                                                   for c in ("sequence_score", "density_score", "consensus_score"))),
    Query("group_summary", "level:s name:s groups:i groups_with_anomalies:i anomalies:i", lambda t: fusion.group_summary(user_flags(t), "user_id"),
          f"""WITH {_USER_FLAGS} SELECT 'total' AS level, CAST(NULL AS VARCHAR) AS name, count(*) AS groups, count(*) FILTER (WHERE a > 0) AS groups_with_anomalies, sum(a) AS anomalies FROM g
 UNION ALL SELECT 'column', event_type, count(*), count(*) FILTER (WHERE a > 0), sum(a) FROM c GROUP BY event_type
 UNION ALL SELECT 'group', CAST(user_id AS VARCHAR), 1, CASE WHEN a > 0 THEN 1 ELSE 0 END, a FROM g"""),
    Query("summary_lines", "line:s", lambda t: writers.summary_lines(fusion.group_summary(user_flags(t), "user_id")),
          f"""WITH {_USER_FLAGS} SELECT 'groups: ' || count(*) AS line FROM g UNION ALL SELECT 'groups with flags: ' || count(*) FILTER (WHERE a > 0) FROM g UNION ALL SELECT 'flags: ' || sum(a) FROM g
 UNION ALL SELECT event_type || ': ' || sum(a) FROM c GROUP BY event_type UNION ALL SELECT * FROM (SELECT user_id || ': ' || a FROM g ORDER BY a DESC, CAST(user_id AS VARCHAR) LIMIT 10) AS best"""),
    Query("top_groups", "name:s anomalies:i", lambda t: fusion.top_groups(fusion.group_summary(user_flags(t), "user_id")),
          f"WITH {_USER_FLAGS} SELECT CAST(user_id AS VARCHAR) AS name, a AS anomalies FROM g ORDER BY a DESC, CAST(user_id AS VARCHAR) LIMIT 10"),
    Query("detect_periods", f"period:d is_target:b {_CONS} severity:s", lambda t: detection.detect_periods(item_months(t)), _detect_sql()),
    Query("quality_pipeline", "period:d metric:s base_column:s dq_dimension:s severity:s overall_severity:s z_score:g explanation:s recommendation:s",
          lambda t: detection.quality_pipeline(t.orders.withColumn("price", F.col("o_totalprice").cast("double")), "o_orderdate", "month", ["price", "o_custkey"])),
    Query("detect_panel", "user_id:i day:d value:f first_score:f second_score:f",
          lambda t: detection.detect_panel(t.events, "user_id", "ts", "event_id", "value"), _panel_sql()),
]
