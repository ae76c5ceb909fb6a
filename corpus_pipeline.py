"""A corpus pipeline of five stages, each an operator of readloom.llm applied to all that the stage before it kept.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: one document of each class of near copies stays;
3. secret scans: secrets in the texts are written over with as many asterisks, every document stays;
4. mixing: documents come as often as the mix of sources takes them (never, once or twice);
5. byte-level BPE: one row for each document of the mix, with its ids' number and digests.

All but the last stage return the columns of `documents`.
Defined results for nulls, empty texts, ties, repeated rows and empty tables are those of the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import bpe, mixing, ngram_join, quality_rules, secrets_scan
from readloom.llm.common import documents, remove, shared_folder

#: No SQL: the divergence rules, the checksums and the merges of the tokenizer can't be said in it.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written as Parquet to the shared folder and read again. A stage's input is deleted once its own result is written; the last one's stays, as the result is made from it."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
