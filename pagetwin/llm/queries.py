"""Queries opN_* of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetwin.llm import bpe, exact, fingerprints, langid, licenses, minhash, packing, passages, quality, shards
from pagetwin.llm.rows import documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.Spec(words=3, num=85, den=100)).select("doc_id", "n_shingles", "component_id", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")



def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir)).select("doc_id", "paragraph", "start", "end", "n_words", "keep_doc_id", "keep_paragraph", "cluster_size", "removed")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit_documents(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.rate_documents(docs, quality.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    weight = F.greatest(F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0)), F.coalesce(F.array_max("detections.weight"), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined(F.concat("base_labels", "detections.label")).alias("labels"), weight.alias("score"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM d
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w),
c AS (SELECT s, list_sort(list_distinct(list(doc_id))) AS ids, min(doc_id) AS a FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
g AS (SELECT a, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT x.a AS a, y.a AS b FROM g x JOIN g y ON x.g = y.g AND x.a <> y.a GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a, min(b) AS b FROM r GROUP BY a),
m AS (SELECT unnest(ids) AS doc_id, b FROM c JOIN k USING (a))
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.b, s.doc_id) AS component_id, coalesce(m.b, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_minhash, op3_exact_dedup, op4_bpe, op5_substring_dedup, op6_langid, op7_quality, op8_packing, op9_shards, op10_licenses)}
ORACLE = {"op2_minhash": OP2_SQL, "op3_exact_dedup": OP3_SQL}
