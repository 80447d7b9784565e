"""The thin queries over the operators of this package, and SQL that says the same where it can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, jaccard_join, language_id, lm_scoring, mixing, quality_classifier, quality_rules, topk_search, toxicity
from ._common import table

BPE_VOCABULARY = "word_bpe_49k.json"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk_search(table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY), full=False)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_bpe": op4_bpe,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_language_id": op6_language_id,
        "op7_html_extract": op7_html_extract,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_quality_rules": op10_quality_rules,
    }


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), x AS (
  SELECT r, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach(r, c) AS (
  SELECT r, r FROM s UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.r
), least_id AS (
  SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.c GROUP BY reach.r
), links AS (
  SELECT a AS r, count(*) AS n_links FROM l GROUP BY a
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM s JOIN least_id USING (r) LEFT JOIN links USING (r)
"""


def _op10_sql() -> str:
    lengths = sorted({quality_rules.BASE_WINDOW, *quality_rules.COVER_LIMITS})
    over = " OR ".join(f"coalesce(cover_{k}, 0) / greatest(bytes, 1) > {limit}" for k, limit in quality_rules.COVER_LIMITS.items())
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), b AS (
  SELECT r, doc_id, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, coalesce(list_sum(list_transform(ws, lambda x: strlen(x))), 0) AS bytes,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM w
), line AS (
  SELECT r, x, strlen(x) AS size, row_number() OVER (PARTITION BY r, x) AS k FROM (SELECT r, unnest(ls) AS x FROM b)
), dup AS (
  SELECT r, count(*) FILTER (k > 1) AS n_dup_lines, sum(size) FILTER (k > 1) / greatest(sum(size), 1) AS share FROM line GROUP BY r
), spans AS (
  SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b, (SELECT unnest({lengths}) AS k))
), twice AS (
  SELECT r, k, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k, g) AS n FROM spans) WHERE n > 1
), covered AS (
  SELECT DISTINCT r, k, unnest(range(i, i + k)) AS j FROM twice
), cover AS (
  SELECT c.r, {', '.join(f"sum(strlen(ws[j])) FILTER (k = {k}) AS cover_{k}" for k in lengths)}, count(*) FILTER (k = {quality_rules.BASE_WINDOW}) AS repeated FROM covered c JOIN b ON b.r = c.r GROUP BY c.r
), f AS (
  SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(share, 0) AS share, coalesce(repeated, 0) AS n_repeat_words, cover.* EXCLUDE (r, repeated),
    n_words < 20 OR 100 * coalesce(repeated, 0) > 30 * n_words AS base_failed
  FROM b LEFT JOIN dup USING (r) LEFT JOIN cover USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR {over} OR share > {quality_rules.LINE_LIMIT} OR n_symbols > {quality_rules.SYMBOL_LIMIT} * n_words) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op10_quality_rules": _op10_sql()}
