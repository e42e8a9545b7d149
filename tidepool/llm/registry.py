"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, fingerprints, language_id, line_dedup, minhash, packing, periodic_runs, pii, quality, suffix_dedup, token_counts, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapsed_runs(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


LINE_DEDUP_SQL = f"""
WITH pages AS (
  SELECT row_number() OVER () AS page, source, coalesce(text, '') AS text FROM documents
), totals AS (
  SELECT source, count(*) AS n_host FROM pages GROUP BY source
), lines AS (
  SELECT DISTINCT source, page, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM pages
), counts AS (
  SELECT source, line, count(*) AS n_pages FROM lines WHERE line <> '' GROUP BY source, line
), boilerplate AS (
  SELECT c.source, list(c.line) AS bad
  FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n_pages >= {line_dedup.MIN_PAGES} AND n_pages > {line_dedup.RATIO}::DOUBLE * n_host
  GROUP BY c.source
)
SELECT doc_id, lang, d.source, n_chars,
       CASE WHEN b.bad IS NULL OR d.text IS NULL THEN d.text
            ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.bad, trim(x, ' '))), chr(10))
       END AS text,
       CASE WHEN b.bad IS NULL OR d.text IS NULL THEN 0
            ELSE len(list_filter(string_split(d.text, chr(10)), lambda x: list_contains(b.bad, trim(x, ' '))))
       END::BIGINT AS n_dropped
FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts, op2_decontamination, op3_suffix_dedup, op4_language_id, op5_packing, op6_personal_data,
        op7_near_duplicates, op8_quality, op9_fingerprints, op10_line_dedup,
        op11_periodic_runs, op12_byte_bpe, op13_embedding_whitening,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": LINE_DEDUP_SQL}
