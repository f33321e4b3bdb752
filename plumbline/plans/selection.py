"""Registered queries: feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import selection as sel

from plumbline.plans.flags import MONTHS_SQL, item_months
from plumbline.plans.registry import Query


def rich_months(t):
    """Month metrics plus two that repeat others."""
    m = item_months(t)
    twin = lambda a, b, f: m.where(F.col("metric") == a).select("period", F.lit(b).alias("metric"), (F.col("value") * f + 1).alias("value"))
    return m.unionByName(twin("price_mean", "price_twin", 2.0)).unionByName(twin("quantity_mean", "quantity_twin", -3.0))



RICH = f"""m0 AS ({MONTHS_SQL}), m AS (SELECT period, metric, coalesce(value, 0) AS value FROM m0 UNION ALL SELECT period, 'price_twin', value * 2 + 1 FROM m0 WHERE metric = 'price_mean'
 UNION ALL SELECT period, 'quantity_twin', value * -3 + 1 FROM m0 WHERE metric = 'quantity_mean')"""


def _pairs(src: str, name: str, kept: str = "") -> str:
    return f"""{name} AS (SELECT b.metric FROM {src} a JOIN {src} b ON a.period = b.period AND a.metric < b.metric {kept} GROUP BY a.metric, b.metric
 HAVING stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 AND abs(corr(a.value, b.value)) > 0.95)"""


def _stable_sql(source: str = RICH) -> str:
    parts, votes = [], []
    for f in range(5):
        parts.append(f"""tr{f} AS (SELECT m.* FROM m JOIN pn ON m.period = pn.period WHERE i < n - (n // 6) * {5 - f}),
v{f} AS (SELECT metric FROM tr{f} GROUP BY 1 HAVING var_samp(value) > 0.001), s{f} AS (SELECT * FROM tr{f} WHERE metric IN (SELECT metric FROM v{f})), {_pairs(f's{f}', f'd{f}')}""")
        votes.append(f"SELECT metric FROM v{f} WHERE metric NOT IN (SELECT metric FROM d{f})")
    return f"""WITH {source}, pn AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM m) AS q), {', '.join(parts)}
SELECT metric, count(*) AS folds, count(*) / 5.0 AS stability, count(*) >= 3 AS stable FROM ({' UNION ALL '.join(votes)}) AS v GROUP BY 1"""


def component_counts(t):
    n = sel.component_count(rich_months(t))
    return t.spark.range(1).select(F.lit(n).alias("components"))


# Forty metrics that all vary and hardly correlate: nothing may be lost on the way.
_MANY = 40


def many_metrics(t):
    """Per day, the summed price of the orders whose key falls into each of forty classes."""
    day, value = F.date_trunc("day", "o_orderdate"), F.col("o_totalprice").cast("double")
    own = t.orders.groupBy(day.alias("period"), F.format_string("class_%02d", F.floor(F.col("o_orderkey") / 4) % _MANY).alias("metric")).agg(F.sum(value).alias("value"))
    days = own.select("period").distinct()
    grid = days.withColumn("metric", F.explode(F.array(*[F.lit(f"class_{i:02d}") for i in range(_MANY)])))
    return grid.join(own, ["period", "metric"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


_MANY_SQL = f"""own AS (SELECT CAST(o_orderdate AS DATE) AS period, printf('class_%02d', CAST((o_orderkey // 4) % {_MANY} AS INTEGER)) AS metric, sum(CAST(o_totalprice AS DOUBLE)) AS value FROM orders GROUP BY 1, 2),
m AS (SELECT d.period, c.metric, coalesce(own.value, 0) AS value FROM (SELECT DISTINCT period FROM own) d CROSS JOIN (SELECT printf('class_%02d', CAST(i AS INTEGER)) AS metric FROM range({_MANY}) r(i)) c
  LEFT JOIN own ON own.period = d.period AND own.metric = c.metric)"""

# Two standardised metrics with correlation r have the components (x +- y) / sqrt(2), which hold (1 + |r|) / 2 and (1 - |r|) / 2 of the variance.
PAIR = ["price_mean", "quantity_mean"]
_PAIR_SQL = f"""WITH {RICH}, x AS (SELECT a.value AS a, b.value AS b FROM m a JOIN m b ON a.period = b.period AND a.metric = '{PAIR[0]}' AND b.metric = '{PAIR[1]}'), r AS (SELECT abs(corr(a, b)) AS r FROM x),
n AS (SELECT unnest({PAIR}) AS metric)"""


def pair_components(t):
    """How many components the pair needs, for three shares of the variance."""
    m = rich_months(t)
    counts = [(share, sel.component_count(m, PAIR, share=share)) for share in (0.5, 0.75, 0.99)]
    return t.spark.createDataFrame(counts, "share double, components int")


def forest_facts(t):
    """Importances add up to 1 and never fall below 0; a metric that does not vary has none."""
    m = rich_months(t)
    flat = m.where("metric = 'row_count'").select("period", F.lit("flat").alias("metric"), F.lit(3.0).alias("value"))
    found = sel.forest_importance(m.unionByName(flat))
    return found.agg(F.count(F.lit(1)).alias("metrics"), F.sum("score").alias("total"), F.min("score").alias("least"), F.max(F.when(F.col("metric") == "flat", F.col("score"))).alias("flat"))


QUERIES = [
    Query("component_count_pair", "share:f components:i", pair_components,
          f"{_PAIR_SQL} SELECT share, CASE WHEN (1 + r) / 2 >= share - 1e-12 THEN 1 ELSE 2 END AS components FROM r, (SELECT unnest([0.5, 0.75, 0.99]) AS share) AS s"),
    Query("loading_rank_pair", "metric:s score:f", lambda t: sel.loading_rank(rich_months(t), PAIR, 2), f"{_PAIR_SQL} SELECT metric, sqrt(2) AS score FROM n"),
    Query("reconstruction_rank_pair", "metric:s error:f", lambda t: sel.reconstruction_rank(rich_months(t), PAIR, 1), f"{_PAIR_SQL} SELECT metric, (1 - r) / 2 AS error FROM n, r"),
    Query("forest_facts", "metrics:i total:f least:f flat:f", forest_facts,
          f"WITH {RICH} SELECT count(DISTINCT metric) + 1 AS metrics, 1.0 AS total, 0.0 AS least, 0.0 AS flat FROM m"),
    Query("variance_filter", "metric:s variance:f keep:b", lambda t: sel.variance_filter(rich_months(t)),
          f"WITH {RICH} SELECT metric, var_pop(value) AS variance, var_pop(value) > 0.01 AS keep FROM m GROUP BY 1"),
    Query("variance_rank", "metric:s variance:f rank:i", lambda t: sel.variance_rank(rich_months(t)),
          f"WITH {RICH}, v AS (SELECT metric, var_samp(value) AS variance FROM m GROUP BY 1) SELECT *, row_number() OVER (ORDER BY variance DESC, metric) AS rank FROM v"),
    Query("corr_filter", "metric:s keep:b", lambda t: sel.correlation_filter(rich_months(t)),
          f"WITH {RICH}, {_pairs('m', 'd')} SELECT DISTINCT metric, metric NOT IN (SELECT metric FROM d) AS keep FROM m"),
    Query("stable_features", "metric:s folds:i stability:f stable:b", lambda t: sel.stable_features(rich_months(t)), _stable_sql()),
    Query("stable_features_wide", "metric:s folds:i stability:f stable:b", lambda t: sel.stable_features(many_metrics(t)), _stable_sql(_MANY_SQL)),
    Query("feature_report", "rank:i metric:s base_column:s metric_type:s score:f",
          lambda t: sel.feature_report(sel.variance_rank(rich_months(t)).select("metric", F.col("variance").alias("score")), 6),
          f"""WITH {RICH}, v AS (SELECT metric, var_samp(value) AS score FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, metric) AS rank FROM v)
 SELECT rank, metric, split_part(metric, '_', 1) AS base_column, CASE WHEN contains(metric, '_') THEN split_part(metric, '_', -1) ELSE 'base' END AS metric_type, score FROM r WHERE rank <= 6"""),
    Query("component_count", "components:i", component_counts),
    Query("forest_importance", "metric:s score:f", lambda t: sel.forest_importance(rich_months(t))),
    Query("reconstruction_rank", "metric:s error:f rank:i", lambda t: sel.reconstruction_rank(rich_months(t))),
    Query("loading_rank", "metric:s score:f rank:i", lambda t: sel.loading_rank(rich_months(t))),
    Query("importance_summary", "metric:s mean_error:f std_error:f importance:f", lambda t: sel.importance_summary(sel.fold_errors(rich_months(t)))),
]
