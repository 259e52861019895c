"""Registered queries of the corpus operators, with DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitaframe.llm import decontaminate, hpylm, near_dup, packing, quality, ranked_search, sharding, substring_dedup, suffix_dedup, topk, toxicity, variants, warc
from vitaframe.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(read(spark, sf_dir, "embeddings"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_sharding": op7_sharding,
    "op8_topk": op8_topk,
    "op9_near_dup": op9_near_dup,
    "op10_packing": op10_packing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS gram FROM item WHERE len(w) BETWEEN 1 AND 9
  UNION
  SELECT DISTINCT item_id, 10 AS size, array_to_string(w[p:p + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM item WHERE len(w) >= 10)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
place AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM doc CROSS JOIN (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT place.doc_id, place.p, place.size, win.item_id FROM place JOIN win USING (size, gram)),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op2_substring_dedup": r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM doc WHERE len(w) >= 50)),
least AS (SELECT gram, min(doc_id) AS first_doc FROM win GROUP BY gram HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, q FROM (
    SELECT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN least USING (gram) WHERE doc_id > first_doc)),
cut AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS q FROM doc),
kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY q) AS stay FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(stay, '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN winner IS NOT NULL AND (page_id IS NULL OR page_id < winner) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id < winner THEN winner END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_inner_product(qv, v) AS BIGINT) AS score
  FROM q JOIN v ON len(q.qv) = len(v.v) AND vec_id <> query_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op9_near_dup": rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w, ' ') AS s FROM doc WHERE len(w) BETWEEN 1 AND 4
  UNION
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM doc WHERE len(w) >= 5)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION
  SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT DISTINCT doc_id FROM doc) LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
    "op11_suffix_dedup": """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
piece AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 1099) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS base FROM doc)),
win AS (
  SELECT doc_id, base + q AS p, md5_number(substr(part, 2 * q + 1, 200)) AS gram
  FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, len(part) // 2 - 99))) AS q FROM piece WHERE len(part) >= 200)),
firsts AS (SELECT gram, min({'d': doc_id, 'p': p}) AS f FROM win GROUP BY gram HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM win JOIN firsts USING (gram) WHERE doc_id > f.d OR doc_id = f.d AND p > f.p),
marked AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later),
island AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
gone AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM island GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, a AS d FROM gone UNION ALL SELECT doc_id, max(b), 1000000000 FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (d - c)), '' ORDER BY c) AS stay FROM gap JOIN doc USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(stay, h))) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op12_ranked_search": rf"""
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN total),
m AS (SELECT doc_id, 100 - 90 + (90 * n * nn) // ll AS m FROM size CROSS JOIN total),
item AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
score AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 10
""",
}
