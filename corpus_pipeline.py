"""A training-data pipeline in five stages, each of them one operator of ``lumenrank.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
reads what it returned, written as Parquet. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenrank.llm import bpe, common, exact_dedup, mixing, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingle sets of similarity 0.8 or more, the one with the least doc_id stays."""
    return simhash.deduplicate_similar(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights, each document a Poisson number of times, in global random order."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, as digests with their number."""
    return bpe.digests(bpe.encode(docs))


STAGES = [("quality_rules", quality), ("exact_dedup", dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("bpe", encode)]
#: SQL has no tokenizer and no shingle sets; tests/llm/test_brute.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder, each until the next one is written."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{i}-{name}")
            out = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                common.remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
        docs = out
    return docs
