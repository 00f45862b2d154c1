"""Query op7_ngram_lm: stupid-backoff scores of all documents under a bigram model of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ngram_lm import scored


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_backoff", F.round(F.col("log_score") * 1_000_000).cast("long").alias("log_score_micro"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), one AS (
  SELECT word, count(*) AS c FROM t GROUP BY word
), pair AS (
  SELECT prev, word, count(*) AS c FROM t WHERE prev IS NOT NULL GROUP BY prev, word
), total AS (
  SELECT count(*) AS n FROM t
), s AS (
  SELECT t.doc_id, coalesce(pair.c >= 2, false) AS known,
    CASE WHEN pair.c >= 2 THEN pair.c::DOUBLE / before.c ELSE CASE WHEN t.prev IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * one.c / total.n END AS v
  FROM t JOIN one ON t.word = one.word CROSS JOIN total
  LEFT JOIN pair ON t.prev = pair.prev AND t.word = pair.word LEFT JOIN one AS before ON t.prev = before.word
), sums AS (
  SELECT doc_id, count(*) FILTER (NOT known) AS b, sum(round(ln(v) * 1000000)::BIGINT)::BIGINT AS u FROM s GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS n_backoff, coalesce(u, 0)::BIGINT AS log_score_micro
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""
