"""Registered queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (budget_mix, context_net, fertility, hard_negatives, licences, line_index, multi_order, perspectives, piece_paths, prefix_trie, rotated_codes,
                           scaled_sketch, warc)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(warc.choose_responses(_table(spark, folder, "pages")))
    return warc.read_archives(manifest).drop("url", "payload")


def op2_rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    return rotated_codes.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judge(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op4_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = budget_mix.mix(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_context_net(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    vectors, network = context_net.fit(docs, _table(spark, folder, "labels"))
    return context_net.score(docs, vectors, network).select("doc_id", context_net.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_multi_order(spark: SparkSession, folder: str) -> DataFrame:
    return multi_order.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op7_piece_paths(spark: SparkSession, folder: str) -> DataFrame:
    return piece_paths.encode_documents(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    out = line_index.without_frequent_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op10_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return perspectives.rotate(_table(spark, folder, "conversations")).withColumn("spans", spans)


def op11_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return scaled_sketch.fingerprint_edited(_table(spark, folder, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec = F.col("vec_id")
    table = _table(spark, folder, "embeddings").withColumn("label", F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(table, vec % 50 == 0)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv_id")
    turns = prefix_trie.numbered(_table(spark, folder, "conversations"))
    turns, convs = prefix_trie.grafted(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8)
    return prefix_trie.trie(turns, convs)


SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
g AS (SELECT digest, max(page_id) AS answer FROM p GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id <> answer THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id <> answer THEN answer END AS refers_to, true AS digest_ok
FROM p JOIN g USING (digest)""",
    "op2_rotated_codes": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    "op10_perspectives": r"""
WITH t AS (
  SELECT conv_id, CAST(floor(turn / 512) AS BIGINT) AS part, turn,
         regexp_replace(coalesce(nullif(trim(role), ''), 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
s AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
p AS (
  SELECT t.*, participant, speaker = participant AS own,
         '<|im_start|>' || CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system'
           ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(text) + 11) OVER (
      PARTITION BY conv_id, participant, part ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM p)
SELECT conv_id, participant, part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE own) AS INTEGER) AS n_trained,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, speaker, text) AS rendered,
       coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(text) + 10), ',' ORDER BY turn, speaker, text) FILTER (WHERE own), '') AS spans
FROM w GROUP BY conv_id, participant, part""",
    "op11_scaled_sketch": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next_text,
         coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM documents WINDOW o AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT doc_id, next_id, text, length(text) AS n_chars, left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) AS edited FROM d),
t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, kind, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '),
                                       lambda x: x <> '') AS w FROM t),
h AS (
  SELECT doc_id, kind, list_sort(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: left(md5(array_to_string(list_slice(w, i, i + 4), ' ')), 16))
    WHEN len(w) > 0 THEN [left(md5(array_to_string(w, ' ')), 16)] ELSE [] END)) AS h FROM w),
s AS (
  SELECT doc_id, kind, CASE WHEN len(list_filter(h, lambda x: x < '2')) >= 32 THEN list_filter(h, lambda x: x < '2') ELSE list_slice(h, 1, 32) END AS s FROM h),
k AS (SELECT doc_id, kind, s, CASE WHEN len(s) < 32 THEN '~' ELSE greatest(s[-1], '1fffffffffffffff') END AS up FROM s),
p AS (
  SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
         list_filter(a.s, lambda x: x <= least(a.up, b.up)) AS a1, list_filter(b.s, lambda x: x <= least(a.up, b.up)) AS b1,
         list_filter(a.s, lambda x: x <= least(a.up, c.up)) AS a2, list_filter(c.s, lambda x: x <= least(a.up, c.up)) AS c2
  FROM e JOIN k AS a ON a.doc_id IS NOT DISTINCT FROM e.doc_id AND a.kind = 0 JOIN k AS b ON b.doc_id IS NOT DISTINCT FROM e.doc_id AND b.kind = 1
  JOIN k AS c ON c.doc_id IS NOT DISTINCT FROM e.next_id AND c.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(a1) + len(b1) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a1, b1))::DOUBLE / (len(a1) + len(b1) - len(list_intersect(a1, b1))) END AS near_edited,
       CASE WHEN len(a2) + len(c2) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a2, c2))::DOUBLE / (len(a2) + len(c2) - len(list_intersect(a2, c2))) END AS near_next
FROM p""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i])) AS BIGINT) AS score
  FROM v AS a JOIN v AS c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.q) = len(c.q)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op13_prefix_trie": """
WITH s AS (
  SELECT conv_id, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sym
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, sym, strlen(x) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sym) AS d FROM s),
c AS (
  SELECT conv_id, max(d) AS own, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
r AS (
  SELECT p.conv_id, t.d, sym, bytes FROM p JOIN t ON t.conv_id = p.base AND t.d <= p.taken
  UNION ALL SELECT p.conv_id, t.d - p.h + p.taken, sym, bytes FROM p JOIN t ON t.conv_id = p.conv_id AND t.d > p.h),
m AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes, (SELECT count(*) FROM r WHERE r.conv_id = p.conv_id) AS own FROM p
  UNION ALL
  SELECT conv_id, d, sha256(string_agg(sym, '') OVER (PARTITION BY conv_id ORDER BY d)), bytes, count(*) OVER (PARTITION BY conv_id) FROM r),
w AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM m),
n AS (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE own = depth), '')) AS ends_sha256
  FROM w GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
u AS (
  SELECT m.depth, m.path, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (depth, path) LEFT JOIN n AS q ON q.depth = f.depth - 1 AND q.path = f.up""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_rotated_codes, op3_fertility, op4_budget_mix, op5_context_net, op6_multi_order, op7_piece_paths, op8_licences, op9_line_dedup, op10_perspectives, op11_scaled_sketch,
                                    op12_hard_negatives, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
