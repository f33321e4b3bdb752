"""Builders for the SQL side of registered queries that repeat per column."""

from __future__ import annotations

from plumbline import vocab

# Date layouts of the text typing, as DuckDB spells them.
_DUCK_LAYOUTS = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d', '%m/%d/%Y']"


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), '{w}')" for w in words) + ")"


def keyword_label_sql(expr: str, labelled, default: str) -> str:
    whens = " ".join(f"WHEN {contains_any_sql(expr, words)} THEN '{label}'" for label, words in labelled)
    return f"CASE {whens} ELSE '{default}' END"


def _type_case(kind: str) -> str:
    if kind == "numeric":
        return "CASE WHEN present = 0 THEN 'unknown' WHEN fractions = 0 THEN 'integer' ELSE 'number' END"
    if kind == "temporal":
        return "CASE WHEN present = 0 THEN 'unknown' ELSE 'date' END"
    pats = " ".join(f"WHEN p{i} / present > 0.8 THEN '{n}'" for i, (n, _) in enumerate(vocab.SEMANTIC_PATTERNS))
    return f"CASE WHEN present = 0 THEN 'unknown' WHEN dates = present THEN 'date' {pats} ELSE 'string' END"


def _scan_sql(src: str, col: str, kind: str) -> str:
    num = f"CAST({col} AS DOUBLE)" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
    txt = f"CAST({col} AS VARCHAR)" if kind == "text" else "CAST(NULL AS VARCHAR)"
    if kind == "temporal":
        dat = f"CAST({col} AS TIMESTAMP)"
    elif kind == "text":
        dat = f"try_strptime({col}, {_DUCK_LAYOUTS})"
    else:
        dat = "CAST(NULL AS TIMESTAMP)"
    pats = ", ".join(
        f"CAST(count(*) FILTER (WHERE regexp_matches(s, {sql_string('^(?:' + p + ')')})) AS DOUBLE) AS p{i}"
        for i, (_, p) in enumerate(vocab.SEMANTIC_PATTERNS)
    )
    pers = " OR ".join(f"regexp_matches(s, {sql_string(p)})" for p in vocab.PII_VALUE_PATTERNS)
    return f"""SELECT '{col}' AS column_name, *, {_type_case(kind)} AS data_type FROM (
  SELECT count(*) AS n, count(x) AS present, count(DISTINCT x) AS distinct_count,
    count(*) FILTER (WHERE v <> floor(v)) AS fractions, min(v) AS mn, max(v) AS mx, avg(v) AS mean, median(v) AS med,
    stddev_samp(v) AS sd, coalesce(bool_or(v = 0), false) AS zeros, coalesce(bool_or(v < 0), false) AS negs,
    quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
    min(length(s)) AS minl, max(length(s)) AS maxl, avg(length(s)) AS avgl, bool_or(regexp_matches(s, '\\d')) AS hn,
    bool_or(regexp_matches(s, '[a-zA-Z]')) AS hl, bool_or(regexp_matches(s, '[^a-zA-Z0-9\\s]')) AS hs,
    min(d) AS mind, max(d) AS maxd, count(d) AS dates, {pats}, coalesce(bool_or({pers}), false) AS personal
  FROM (SELECT {col} AS x, {num} AS v, {txt} AS s, {dat} AS d FROM ({src}) AS base) AS cells) AS agg"""


def _personal_sql() -> str:
    types = ", ".join(f"'{t}'" for t in vocab.PII_SEMANTIC_TYPES)
    return (
        f"({contains_any_sql('column_name', vocab.PII_NAME_INDICATORS)} OR data_type IN ({types}) "
        "OR (data_type = 'string' AND personal))"
    )


def column_profile_sql(src: str, columns) -> str:
    scans = "\nUNION ALL\n".join(_scan_sql(src, c, k) for c, k in columns)
    num, txt, dat = "data_type IN ('number', 'integer')", "data_type = 'string'", "data_type = 'date'"
    keep = lambda cond, e, name: f"CASE WHEN {cond} THEN {e} END AS \"{name}\""
    return f"""SELECT column_name, data_type, true AS nullable, n - present AS null_count,
  round((n - present) * 100.0 / n, 2) AS null_percentage, distinct_count,
  round(distinct_count * 100.0 / n, 2) AS distinct_percentage,
  coalesce(distinct_count / CAST(nullif(present, 0) AS DOUBLE), 0) AS unique_ratio,
  {keep(num, 'mn', 'min')}, {keep(num, 'mx', 'max')}, {keep(num, 'round(mean, 2)', 'mean')}, {keep(num, 'med', 'median')},
  {keep(num, 'round(sd, 2)', 'std')}, {keep(num, 'zeros', 'has_zeros')}, {keep(num, 'negs', 'has_negatives')},
  {keep(num, 'q1', 'quartile_1')}, {keep(num, 'q3', 'quartile_3')}, {keep(txt, 'minl', 'min_length')},
  {keep(txt, 'maxl', 'max_length')}, {keep(txt, 'round(avgl, 2)', 'avg_length')}, {keep(txt, 'hn', 'has_numbers')},
  {keep(txt, 'hl', 'has_letters')}, {keep(txt, 'hs', 'has_special_chars')}, {keep(dat, 'mind', 'min_date')},
  {keep(dat, 'maxd', 'max_date')},
  CASE WHEN {dat} THEN floor((epoch(maxd) - epoch(mind)) / 86400) END AS date_range_days,
  {_personal_sql()} AS is_pii
FROM ({scans}) AS scans"""


def type_sql(src: str, columns) -> str:
    scans = "\nUNION ALL\n".join(_scan_sql(src, c, k) for c, k in columns)
    return f"SELECT column_name, data_type, {_personal_sql()} AS is_pii FROM ({scans}) AS scans"


def long_sql(src: str, keys: list[str], cols: list[str], cast: str = "DOUBLE") -> str:
    """(keys, column, value) as a union of one select per column."""
    k = "".join(f"{x}, " for x in keys)
    return "\nUNION ALL\n".join(f"SELECT {k}'{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {src}" for c in cols)


def metrics_sql(src: str, names, column: str | None = '"column"') -> str:
    """(period, metric, value): one select per metric column, named after ``column``, or alone."""
    return "\nUNION ALL\n".join(
        f"SELECT period, {column + ' || ' if column else ''}'{'_' if column else ''}{n}' AS metric, CAST(\"{n}\" AS DOUBLE) AS value FROM {src}" for n in names)


def bin_sql(v: str, lo: str, hi: str, bins: str) -> str:
    return (f"CASE WHEN {hi} > {lo} THEN least(floor(({v} - {lo}) * {bins} / nullif({hi} - {lo}, 0)), {bins} - 1) "
            f"ELSE floor({bins} * 0.5) END")


def numeric_window_sql(src: str, ts: str, period: str, cols: list[str]) -> str:
    """All number metrics per (period, column), the same list as the Spark operator."""
    return f"""WITH base AS (SELECT date_trunc('{period}', {ts}) AS period, * FROM ({src}) AS s0),
long AS ({long_sql('base', ['period'], cols)}),
facts AS (SELECT period, "column", count(*) AS n, count(value) AS cnt, avg(value) AS mean, median(value) AS med,
    CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS sd, min(value) AS mn, max(value) AS mx,
    quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.95) AS q95,
    quantile_cont(value, 0.99) AS q99,
    CASE WHEN count(value) > 2 AND max(value) > min(value) THEN skewness(value) END AS skew,
    CASE WHEN count(value) > 3 AND max(value) > min(value) THEN kurtosis(value) END AS kurt,
    count(*) FILTER (WHERE value = 0) AS zeros, count(*) FILTER (WHERE value < 0) AS negs,
    count(DISTINCT value) AS uniq FROM long GROUP BY 1, 2),
overall AS (SELECT "column", avg(value) AS gm, stddev_samp(value) AS gs FROM long GROUP BY 1),
shape AS (SELECT *, CASE WHEN mx > mn THEN ceil((mx - mn) / (CASE WHEN q3 - q1 > 0
      THEN least((mx - mn) / (log2(cnt) + 1), 2 * (q3 - q1) / cbrt(cnt)) ELSE (mx - mn) / (log2(cnt) + 1) END)) ELSE 1 END AS bins
  FROM facts),
cells AS (SELECT l.period, l."column", l.value, s.cnt, s.q1, s.q3, s.bins,
    CASE WHEN s.mx > s.mn THEN (s.mx - s.mn) / s.bins ELSE 1.0 END AS width,
    {bin_sql('l.value', 's.mn', 's.mx', 's.bins')} AS bin
  FROM long l JOIN shape s ON l.period = s.period AND l."column" = s."column" WHERE l.value IS NOT NULL),
bars AS (SELECT period, "column", bin, any_value(cnt) AS cnt, any_value(width) AS width, count(*) AS c,
    count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outs
  FROM cells GROUP BY 1, 2, 3),
spread AS (SELECT period, "column", sum(outs) AS outs, -sum((c / (cnt * width)) * ln(c / (cnt * width))) AS ent
  FROM bars GROUP BY 1, 2)
SELECT f.period, f."column", cnt AS count, n - cnt AS missing_count, (n - cnt) * 100.0 / n AS missing_pct, mean,
  med AS median, sd AS std, mn AS min, mx AS max, mx - mn AS range, q1 AS p25, q3 AS p75, q95 AS p95, q99 AS p99,
  q3 - q1 AS iqr, skew, kurt, CASE WHEN gm <> 0 THEN (mean - gm) / gm ELSE 0 END AS mean_vs_global,
  CASE WHEN gs <> 0 THEN (sd - gs) / gs ELSE 0 END AS std_vs_global,
  CASE WHEN gs > 0 THEN (mean - gm) / gs ELSE 0 END AS zscore, outs AS outliers_count,
  outs * 100.0 / nullif(cnt, 0) AS outliers_pct, ent AS entropy, uniq AS unique_count,
  uniq * 100.0 / nullif(cnt, 0) AS unique_pct, zeros AS zero_count, zeros * 100.0 / nullif(cnt, 0) AS zero_pct,
  negs AS negative_count, negs * 100.0 / nullif(cnt, 0) AS negative_pct, sd / nullif(abs(mean), 0) AS cv
FROM facts f JOIN overall o ON f."column" = o."column"
LEFT JOIN spread p ON f.period = p.period AND f."column" = p."column\""""


def corr_sql(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND "
            f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN corr({a}, {b}) END")
