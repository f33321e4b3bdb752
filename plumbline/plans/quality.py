"""Registered queries: quality profile per day or month."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import quality_profile as qp
from plumbline.plans.registry import Query
from plumbline.plans.sqltext import bin_sql, corr_sql, long_sql
from plumbline.plans.windows import EVENT_SQL, ITEM_COLS, items, sparse_events

_EVENTS = f"""base AS (SELECT date_trunc('day', ts) AS period, value FROM ({EVENT_SQL}) AS e),
long AS (SELECT period, 'value' AS "column", value FROM base)"""
_ITEMS = f"""base AS (SELECT date_trunc('month', l_shipdate) AS period, {', '.join(ITEM_COLS)} FROM lineitem),
long AS ({long_sql('base', ['period'], ITEM_COLS)})"""


def _distribution_sql(source: str) -> str:
    return f"""WITH {source},
e AS (SELECT period, "column", min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS d, count(value) AS n FROM long GROUP BY 1, 2),
c AS (SELECT l.period, l."column", {bin_sql('l.value', 'lo', 'hi', '10')} AS w, {bin_sql('l.value', 'lo', 'hi', 'least(50, d)')} AS f
  FROM long l JOIN e ON l.period = e.period AND l."column" = e."column" WHERE l.value IS NOT NULL),
h AS (SELECT period, "column", concat_ws(',', {', '.join(f'count(*) FILTER (WHERE w = {i})' for i in range(10))}) AS "Histogram" FROM c GROUP BY 1, 2),
p AS (SELECT period, "column", f, count(*) AS k FROM c GROUP BY 1, 2, 3),
q AS (SELECT *, k / sum(k) OVER (PARTITION BY period, "column") AS p FROM p),
s AS (SELECT period, "column", -sum(p * log2(p)) AS "Entropy" FROM q GROUP BY 1, 2)
SELECT e.period, e."column", d AS "CountDistinct", d / CAST(n AS DOUBLE) AS "Uniqueness", d / CAST(n AS DOUBLE) AS "UniqueValueRatio",
  d / CAST(n AS DOUBLE) AS "Distinctness", "Entropy", "Histogram" FROM e JOIN h ON e.period = h.period AND e."column" = h."column"
JOIN s ON e.period = s.period AND e."column" = s."column\""""


_DIST = "period:d column:s CountDistinct:i Uniqueness:f UniqueValueRatio:f Distinctness:f"
_QUANT = "period:d column:s " + " ".join(f"ApproxQuantiles_{p}:f" for p in (0.1, 0.25, 0.5, 0.75, 0.9))

_MI_COLS = ITEM_COLS[1:]
_MI_SQL = f"""WITH base AS (SELECT date_trunc('month', l_shipdate) AS period, {', '.join(ITEM_COLS)} FROM lineitem),
pairs AS ({' UNION ALL '.join(f'''SELECT period, '{c}' AS "column", l_quantity AS x, {c} AS y FROM base''' for c in _MI_COLS)}),
e AS (SELECT period, "column", min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pairs GROUP BY 1, 2),
b AS (SELECT p.period, p."column",
   CASE WHEN hx > lx THEN least(greatest(ceil((x - lx) / ((hx - lx) / 10.0)), 1), 10) ELSE 5 END AS bx,
   CASE WHEN hy > ly THEN least(greatest(ceil((y - ly) / ((hy - ly) / 10.0)), 1), 10) ELSE 5 END AS by_
   FROM pairs p JOIN e ON p.period = e.period AND p."column" = e."column"),
j AS (SELECT period, "column", bx, by_, count(*) AS n FROM b GROUP BY 1, 2, 3, 4),
w AS (SELECT *, sum(n) OVER (PARTITION BY period, "column", bx) AS nx, sum(n) OVER (PARTITION BY period, "column", by_) AS ny,
   sum(n) OVER (PARTITION BY period, "column") AS t FROM j)
SELECT period, "column", sum(n / t * log2(n * t / (nx * ny))) AS "MutualInformation" FROM w GROUP BY 1, 2"""


def _correlation_sql() -> str:
    pairs = [(c, o) for c in ITEM_COLS for o in ITEM_COLS[:5] if c != o]
    key = lambda c, o: sorted((c, o))
    return "\nUNION ALL\n".join(
        f"""SELECT date_trunc('month', l_shipdate) AS period, '{c}' AS "column", '{o}' AS other, {corr_sql(*key(c, o))} AS correlation
        FROM lineitem GROUP BY 1""" for c, o in pairs)


def flagged_items(t):
    """Line items with a text column that has gaps."""
    return t.lineitem.select("l_shipdate", *ITEM_COLS, F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("l_returnflag"))


_BASIC_SQL = f"""WITH {_ITEMS} SELECT period, "column", avg(value) AS "Mean", min(value) AS "Minimum", max(value) AS "Maximum",
 stddev_samp(value) AS "StandardDeviation", sum(value) AS "Sum", count(*) AS count, count(value) / CAST(count(*) AS DOUBLE) AS "Completeness",
 count(*) - count(value) AS "missingCount", count(*) FILTER (WHERE value = 0) AS "zeroCount",
 count(*) FILTER (WHERE value = 0) * 100.0 / count(value) AS "zeroCountPercentage", count(*) FILTER (WHERE value < 0) AS "negativeCount",
 count(*) FILTER (WHERE value < 0) * 100.0 / count(value) AS "negativeCountPercentage", count(*) AS "Size", 0 AS "MinLength", 0 AS "MaxLength",
 'DECIMAL' AS "DataType" FROM long GROUP BY 1, 2"""
_QUANTILE_SQL = f"""WITH {_ITEMS} SELECT period, "column", """ + ", ".join(
    f'quantile_cont(value, {p}) AS "ApproxQuantiles_{p}"' for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM long GROUP BY 1, 2"
_PARTS = {
    "b": (_BASIC_SQL, "Mean Minimum Maximum StandardDeviation Sum count Completeness missingCount zeroCount zeroCountPercentage negativeCount negativeCountPercentage Size MinLength MaxLength".split()),
    "d": (_distribution_sql(_ITEMS), "CountDistinct Uniqueness UniqueValueRatio Distinctness Entropy".split()),
    "q": (_QUANTILE_SQL, [f"ApproxQuantiles_{p}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)]),
    "i": (_MI_SQL, ["MutualInformation"]),
    "s": ("""SELECT date_trunc('month', l_shipdate) AS period, 'dataset' AS "column", count(*) AS total_records, """
          f"({' + '.join(f'count({c})' for c in ITEM_COLS)}) / (count(*) * {len(ITEM_COLS)}.0) AS dataset_completeness FROM lineitem GROUP BY 1", ["total_records", "dataset_completeness"]),
    "l": ("""SELECT date_trunc('month', l_shipdate) AS period, 'l_returnflag' AS "column", count(*) AS "Size", min(CASE WHEN l_linenumber <> 3 THEN length(l_returnflag) END) AS "MinLength",
 max(CASE WHEN l_linenumber <> 3 THEN length(l_returnflag) END) AS "MaxLength" FROM lineitem GROUP BY 1""", ["Size", "MinLength", "MaxLength"]),
}


def _whole_sql() -> str:
    ctes = ",\n".join(f"{k} AS MATERIALIZED ({sql})" for k, (sql, _) in _PARTS.items())
    rows = [f"""SELECT period, "column", '{n}' AS metric, CAST("{n}" AS DOUBLE) AS value FROM {k}""" for k, (_, names) in _PARTS.items() for n in names]
    rows.append(f"""SELECT period, "column", 'Correlation_' || other AS metric, correlation AS value FROM ({_correlation_sql()}) AS c""")
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(rows)


def hist_table(t):
    return qp.histogram_features(qp.distribution_metrics(items(t), "l_shipdate", "month", ITEM_COLS))


QUERIES = [
    Query("quality_metrics", "period:d column:s metric:s value:f", lambda t: qp.quality_metrics(flagged_items(t), "l_shipdate", "month"), _whole_sql()),
    Query("dq_basic",
          "period:d column:s Mean:f Minimum:f Maximum:f StandardDeviation:f Sum:g count:i Completeness:f missingCount:i zeroCount:i "
          "zeroCountPercentage:f negativeCount:i negativeCountPercentage:f Size:i MinLength:i MaxLength:i DataType:s",
          lambda t: qp.basic_metrics(items(t), "l_shipdate", "month", ITEM_COLS),
          _BASIC_SQL),
    Query("dq_distribution", _DIST, lambda t: qp.distribution_metrics(sparse_events(t), "ts", "day", ["value"]), _distribution_sql(_EVENTS)),
    Query("dq_histogram", "period:d column:s Histogram:s", lambda t: qp.distribution_metrics(items(t), "l_shipdate", "month", ITEM_COLS),
          _distribution_sql(_ITEMS)),
    Query("dq_entropy", "period:d column:s Entropy:f", lambda t: qp.distribution_metrics(items(t), "l_shipdate", "month", ITEM_COLS),
          _distribution_sql(_ITEMS)),
    Query("dq_quantiles", _QUANT, lambda t: qp.quantile_metrics(items(t), "l_shipdate", "month", ITEM_COLS),
          _QUANTILE_SQL),
    Query("dq_correlation", "period:d column:s other:s correlation:f",
          lambda t: qp.correlations(items(t), "l_shipdate", ITEM_COLS, "month"), _correlation_sql()),
    Query("dq_mi", "period:d column:s MutualInformation:f",
          lambda t: qp.mutual_information(items(t), "l_shipdate", ITEM_COLS, "month"), _MI_SQL),
    Query("dq_dataset", "period:d total_records:i dataset_completeness:f",
          lambda t: qp.dataset_metrics(sparse_events(t), "ts", "day", ["event_id", "user_id", "value"]),
          f"""SELECT date_trunc('day', ts) AS period, count(*) AS total_records,
 (count(event_id) + count(user_id) + count(value)) / (count(*) * 3.0) AS dataset_completeness FROM ({EVENT_SQL}) AS e GROUP BY 1"""),
    Query("dq_lengths", "period:d column:s Size:i MinLength:i MaxLength:i",
          lambda t: qp.text_lengths(t.events, "ts", ["event_type", "props"]),
          """SELECT date_trunc('day', ts) AS period, 'event_type' AS "column", count(*) AS "Size", min(length(event_type)) AS "MinLength",
 max(length(event_type)) AS "MaxLength" FROM events GROUP BY 1 UNION ALL
 SELECT date_trunc('day', ts), 'props', count(*), min(length(props)), max(length(props)) FROM events GROUP BY 1"""),
    Query("hist_features", "period:d column:s hist_mean:f hist_std:f hist_sum:f hist_max:f hist_entropy:f", hist_table,
          f"""WITH d AS ({_distribution_sql(_ITEMS)}), u AS (SELECT period, "column", CAST(unnest(string_split("Histogram", ',')) AS DOUBLE) AS x FROM d),
 w AS (SELECT *, sum(x) OVER (PARTITION BY period, "column") AS s FROM u)
 SELECT period, "column", avg(x) AS hist_mean, stddev_pop(x) AS hist_std, sum(x) AS hist_sum, max(x) AS hist_max,
  -sum((x / s) * log2(x / s + 1e-12)) AS hist_entropy FROM w GROUP BY 1, 2"""),
]
