"""Training-data pipeline over `documents`: each stage works on all that the one before it kept.

All stages but the last return the columns of documents, other columns as they are whatever their names.
Rows are never matched by doc_id alone, so null and repeated ids are no special case; an empty table gives
no rows in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagetwin.llm import exact, minhash, packing, quality, substrings
from pagetwin.session import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null texts and texts of white space go; equal rows stay or go together."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id (null is smallest); null counts as empty; of wholly equal rows one stays."""
    return exact.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group, that of the smallest (doc_id, text); texts without words are near nothing and stay."""
    return minhash.drop_near(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, near copies of paragraphs (MinHash banding, then a comparison word by word) and repeated passages cut from all places but the first by doc_id (null first); null texts stay null, a text of repeats only becomes empty."""
    return substrings.cut_paragraphs(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document; null and empty texts are the end id alone; equal rows are packed each for itself."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to shared storage and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.keep(docs)
    return docs
