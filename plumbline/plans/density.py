"""Registered queries: density scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cleaning, density, neighbours
from plumbline.plans.registry import Query

FEATURES = ["value", "k"]


def measured_events(t):
    """Events with two numbers: the value and the number inside the properties."""
    return t.events.select("event_id", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


_ROWS = """r AS (SELECT event_id, event_id % 5 AS fold, value, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events),
l AS (SELECT event_id, fold, 'value' AS f, value AS v FROM r UNION ALL SELECT event_id, fold, 'k', k FROM r)"""


def _combine(method: str, u: str = "") -> str:
    by = f"CASE WHEN s{u} > 0 THEN r{u} WHEN s{u} < 0 THEN l{u} ELSE l{u} + r{u} END"
    return f"greatest(l{u}, r{u}, {by})" if method == "ecod" else f"greatest({by}, (l{u} + r{u}) / 2)"


def _tails_sql(method: str) -> str:
    """Scores by plain windows: all rows, and for each fold the rows outside it."""
    tail = lambda where: f"""SELECT f, v, -ln(sum(c) OVER (PARTITION BY f ORDER BY v) / sum(c) OVER (PARTITION BY f)) AS l,
 -ln(sum(c) OVER (PARTITION BY f ORDER BY v DESC) / sum(c) OVER (PARTITION BY f)) AS r FROM (SELECT f, v, count(*) AS c FROM l {where} GROUP BY 1, 2) AS q"""  # noqa: E731
    parts = [f"t AS ({tail('')}), sk AS (SELECT f, coalesce(skewness(v), 0) AS s FROM l GROUP BY 1)",
             f"sc_{method} AS (SELECT event_id, fold, sum({_combine(method)}) AS score FROM l JOIN t ON l.f = t.f AND l.v = t.v JOIN sk ON l.f = sk.f GROUP BY 1, 2)"]
    for i in range(5):
        parts.append(f"t{i} AS ({tail(f'WHERE fold <> {i}')}), sk{i} AS (SELECT f, coalesce(skewness(v), 0) AS s FROM l WHERE fold <> {i} GROUP BY 1)")
        parts.append(f"tr{i} AS (SELECT event_id, sum({_combine(method)}) AS score FROM l JOIN t{i} ON l.f = t{i}.f AND l.v = t{i}.v JOIN sk{i} ON l.f = sk{i}.f WHERE fold <> {i} GROUP BY 1)")
    limits = " UNION ALL ".join(f"SELECT {i} AS fold, quantile_cont(score, 0.99) AS threshold FROM tr{i}" for i in range(5))
    return f"{', '.join(parts)}, lim AS ({limits})"


def _fold_sql(method: str) -> str:
    return f"""WITH {_ROWS}, {_tails_sql(method)} SELECT event_id, s.fold, score, threshold, CASE WHEN score > threshold THEN 1 ELSE 0 END AS flag
 FROM sc_{method} s JOIN lim ON s.fold = lim.fold"""


_ENSEMBLE_SQL = f"""WITH {_ROWS}, t AS (SELECT f, v, -ln(sum(c) OVER (PARTITION BY f ORDER BY v) / sum(c) OVER (PARTITION BY f)) AS l,
 -ln(sum(c) OVER (PARTITION BY f ORDER BY v DESC) / sum(c) OVER (PARTITION BY f)) AS r FROM (SELECT f, v, count(*) AS c FROM l GROUP BY 1, 2) AS q),
sk AS (SELECT f, coalesce(skewness(v), 0) AS s FROM l GROUP BY 1),
b AS (SELECT event_id, fold, sum({_combine('ecod')}) AS ecod, sum({_combine('copod')}) AS copod FROM l JOIN t ON l.f = t.f AND l.v = t.v JOIN sk ON l.f = sk.f GROUP BY 1, 2),
n AS (SELECT *, ((ecod - min(ecod) OVER w) / greatest(max(ecod) OVER w - min(ecod) OVER w, 1e-10) + (copod - min(copod) OVER w) / greatest(max(copod) OVER w - min(copod) OVER w, 1e-10)) / 2 AS score
 FROM b WINDOW w AS (PARTITION BY fold)), h AS (SELECT fold, quantile_cont(score, 0.99) AS threshold FROM n GROUP BY 1)
SELECT event_id, n.fold, ecod, copod, score, threshold, CASE WHEN score > threshold THEN 1 ELSE 0 END AS flag FROM n JOIN h ON n.fold = h.fold"""

_OOF = "event_id:i fold:i score:f threshold:f flag:i"


def order_points(t):
    """One point per day: number and mean price of orders, standardised."""
    d = t.orders.groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    return cleaning.scale(d, ["orders", "price"])


_POINTS = """d AS (SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(count(*) AS DOUBLE) AS orders, avg(o_totalprice) AS price FROM orders GROUP BY 1),
p AS (SELECT day, (orders - avg(orders) OVER ()) / stddev_pop(orders) OVER () AS orders, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS price FROM d)"""
_LOF_SQL = f"""WITH {_POINTS}, nn AS (SELECT a.day, b.day AS other, sqrt((a.orders - b.orders) ** 2 + (a.price - b.price) ** 2) AS distance,
  row_number() OVER (PARTITION BY a.day ORDER BY sqrt((a.orders - b.orders) ** 2 + (a.price - b.price) ** 2), b.day) AS rank FROM p a JOIN p b ON a.day <> b.day QUALIFY rank <= 20),
k AS (SELECT day, max(distance) AS kd FROM nn GROUP BY 1), lrd AS (SELECT nn.day, 1 / (avg(greatest(distance, k.kd)) + 1e-10) AS lrd FROM nn JOIN k ON nn.other = k.day GROUP BY 1),
m AS (SELECT nn.day, avg(lrd.lrd) AS m FROM nn JOIN lrd ON nn.other = lrd.day GROUP BY 1)
SELECT m.day, m / lrd AS score FROM m JOIN lrd ON m.day = lrd.day"""

_MEASURED = "r AS (SELECT event_id, value, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events)"

QUERIES = [
    Query("ecod", _OOF, lambda t: density.out_of_fold(measured_events(t), "event_id", FEATURES), _fold_sql("ecod")),
    Query("copod", _OOF, lambda t: density.out_of_fold(measured_events(t), "event_id", FEATURES, "copod"), _fold_sql("copod")),
    Query("ensemble", "event_id:i fold:i ecod:f copod:f score:f threshold:f flag:i", lambda t: density.ensemble(measured_events(t), "event_id", FEATURES), _ENSEMBLE_SQL),
    Query("many_targets", "target:s flagged:i total:f",
          lambda t: density.many_targets(measured_events(t), "event_id", FEATURES).groupBy("target").agg(F.sum("flag").alias("flagged"), F.avg("score").alias("total")),
          f"WITH x AS ({_fold_sql('ecod')}), t AS (SELECT unnest(['value', 'k']) AS target) SELECT target, sum(flag) AS flagged, avg(score) AS total FROM x, t GROUP BY 1"),
    Query("lof", "day:i score:f", lambda t: neighbours.local_outlier_factor(order_points(t), "day", ["orders", "price"]), _LOF_SQL),
    Query("mean_distance", "event_id:i score:f", lambda t: density.mean_distance(measured_events(t), FEATURES),
          f"""WITH {_MEASURED} SELECT event_id, least(1, (abs(value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-8) + abs(k - avg(k) OVER ()) / (stddev_pop(k) OVER () + 1e-8)) / 2 / 10) AS score FROM r"""),
    Query("z_norm", "event_id:i score:f flag:i", lambda t: density.z_norm(measured_events(t), FEATURES),
          f"""WITH {_MEASURED}, z AS (SELECT event_id, sqrt(((value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-8)) ** 2 + ((k - avg(k) OVER ()) / (stddev_pop(k) OVER () + 1e-8)) ** 2) AS z FROM r)
 SELECT event_id, z / (max(z) OVER () + 1e-8) AS score, CASE WHEN z / (max(z) OVER () + 1e-8) >= 0.95 THEN 1 ELSE 0 END AS flag FROM z"""),
    Query("mahalanobis", "event_id:i score:f", lambda t: density.mahalanobis(measured_events(t), FEATURES),
          f"""WITH {_MEASURED}, c AS (SELECT avg(value) AS ma, avg(k) AS mb, var_samp(value) AS a, covar_samp(value, k) AS b, var_samp(k) AS d FROM r)
 SELECT event_id, (d * (value - ma) ** 2 - 2 * b * (value - ma) * (k - mb) + a * (k - mb) ** 2) / (a * d - b * b) AS score FROM r, c"""),
    Query("cblof", "event_id:i cluster:i score:f flag:i", lambda t: density.cluster_scores(measured_events(t), ["event_id"], FEATURES)),
]
