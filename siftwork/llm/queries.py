"""The training-data queries registered in the entry file, and their SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import decontaminate, langid, licenses, packing, phrases, quality, secrets, simhash, suffixes, vamana
from siftwork.sources.tables import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1_packing(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_simhash(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op3_suffixes(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4_secrets(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.op5_neighbours(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8_language_id(table(spark, sf_dir, "documents"))


def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op9_phrases(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_suffixes, op4_secrets, op5_neighbours, op6_decontamination, op7_quality, op8_language_id, op9_phrases, op10_licenses)}
#: The others rest on hashes, models, graphs or byte strings that SQL lacks; tests/llm has brute force for them.
ORACLE_SQL: dict[str, str] = {
    "op9_phrases": r"""WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS s FROM documents),
x AS (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i, len(s) AS n FROM w),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS t FROM x),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS owner FROM g WHERE i <= n - 12),
b AS (SELECT DISTINCT doc_id, i + d AS i FROM f, (SELECT unnest(range(13)) AS d) WHERE owner < doc_id),
k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN b USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, cast(len(s) AS BIGINT) AS n_words, cast(len(s) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}
