"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.html_extraction import extract_main_text, fit

    return extract_main_text(_table(spark, sf_dir, "pages"), fit())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.ngram_join import ngram_classes

    return ngram_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.url_filter import filter_urls, fit

    return filter_urls(_table(spark, sf_dir, "pages"), fit()).select("page_id", "host", "path", "rule", "verdict")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontamination import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.toxicity import fit, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents"), with_hash=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html_extraction, op2_ngram_join, op3_url_filter, op4_substring_dedup, op5_decontamination, op6_toxicity, op7_mixing, op8_line_dedup, op9_embedding_dedup, op10_suffix_dedup)}

ORACLES: dict[str, str] = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT keyed.doc_id, line, pos, first_doc IS NOT NULL AND first_doc <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE k >= 0.8 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT c.x AS doc_id, c.class_id, coalesce(d.n_links, 0) AS n_links FROM (SELECT x, min(y) AS class_id FROM r GROUP BY x) c LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY x) d ON c.x = d.x""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) t(i)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM dup, range(35) t(k)),
kept AS (SELECT w.doc_id, j, ws[j] AS word, g.j IS NULL AS stays FROM w CROSS JOIN LATERAL unnest(range(1, len(ws) + 1)) t(j) LEFT JOIN gone g USING (doc_id, j))
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (NOT stays) AS n, string_agg(word, ' ' ORDER BY j) FILTER (stays) AS rest FROM kept GROUP BY doc_id) k ON w.doc_id = k.doc_id""",
    "op9_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT c.x AS vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.x = c.component_id AS kept FROM (SELECT x, min(y) AS component_id FROM r GROUP BY x) c LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) d ON c.x = d.x""",
    "op10_suffix_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM b, unnest(range(0, length(x) // 2 - 199)) t(i)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM dup)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
per AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS rest FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN per.doc_id IS NULL THEN x ELSE rest || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM b LEFT JOIN per ON b.doc_id = per.doc_id""",
}
