"""Queries of the training-data operators, and oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import bpe, crosstok, decontaminate, html, licences, neardup, quality, ranked, secrets, sharding, simhash, toxicity, wordpiece
from siftlake.session import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op2_html(table(spark, sf_dir, "pages"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.op3_token_counts(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4_sharding(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op6_licences(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op7_near_duplicates(table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op8_bpe(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op9_secrets(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op11_simhash(table(spark, sf_dir, "documents"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.op12_cross_tokenizer(table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.op13_ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quality rules are learned from and the base decides: no label is read."""
    out = quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in (*quality.BASE, "base_failed")))


def _token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op3(spark, sf_dir).select("doc_id", "n_words")


def _secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op9(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def _shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shard whether its slots are gapless from 0, and its bytes within a fiftieth of the mean, or the longest text, of it."""
    own = _op4(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.sum("size").alias("bytes"), F.max("size").alias("most"))
    mean = own.agg((F.sum("bytes") / sharding.SHARDS).alias("mean"), F.max("most").alias("longest"))
    gapless = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    return own.crossJoin(F.broadcast(mean)).select("shard", gapless.alias("gapless"), (F.abs(F.col("bytes") - F.col("mean")) <= F.greatest(F.col("mean") / 50, F.col("longest"))).alias("near_equal"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _op1,
        "op2_html": _op2,
        "op3_token_counts": _op3,
        "op4_sharding": _op4,
        "op5_toxicity": _op5,
        "op6_licences": _op6,
        "op7_near_duplicates": _op7,
        "op8_bpe": _op8,
        "op9_secrets": _op9,
        "op10_decontamination": _op10,
        "op11_simhash": _op11,
        "op12_cross_tokenizer": _op12,
        "op13_ranked": _op13,
        "pipeline": corpus_pipeline.run,
        # Columns of the above that SQL can express.
        "quality_base": _quality_base,
        "token_words": _token_words,
        "secret_counts": _secret_counts,
        "shard_laws": _shard_laws,
    }


#: All pairs by shared shingles, then everything that a document reaches.
_OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT doc_id, k, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS x FROM places WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
held AS (SELECT DISTINCT doc_id, x FROM runs WHERE i = 1 OR i <= k - 4),
sizes AS (SELECT doc_id, count(x) AS n FROM documents LEFT JOIN held USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""


_QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
runs AS (SELECT doc_id, k, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS x FROM places WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM runs WHERE i <= k - 4) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(5)) AS d) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM t JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
"""
_WORDS_SQL = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words FROM documents"
_SECRET_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM t
"""
_SHARD_SQL = "SELECT CAST(unnest(range(24)) AS INTEGER) AS shard, true AS gapless, true AS near_equal"


#: Every document that shares a term with an item is scored.
_OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, t FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals WHERE t IN (SELECT t FROM asked) GROUP BY t, docs),
lengths AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // length AS m FROM docs, totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: learned models, greedy packing and matching, BPE, alignment, HTML, and look-around patterns."""
    return {"op7_near_duplicates": _OP7_SQL, "op13_ranked": _OP13_SQL, "quality_base": _QUALITY_SQL, "token_words": _WORDS_SQL, "secret_counts": _SECRET_SQL, "shard_laws": _SHARD_SQL}
