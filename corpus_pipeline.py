"""Corpus pipeline: quality rules, near-dedup, suffix-array dedup, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as Parquet into the shared folder of
spark.checkpoint.dir and reads it again as the next one's docs. All stages but the last keep the columns of documents.
A stage's folder is deleted once the next one is written; the last one's holds the result and stays.
Near-dedup works on five-word shingles at a similarity of 0.8. Suffix-array dedup drops texts that nothing is left of.
An empty table goes through all stages as an empty table. Null and empty texts fail the first stage's limits; null
languages and sources are groups of their own; repeated rows are near duplicates, of which rows with the least doc_id stay
(all of them where they share it), and what copies with one doc_id share goes in the third stage; other columns of the
documents are carried to the fourth stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.llm import bpe, decontaminate, near_dedup, quality_rules, suffix_dedup
from spectralake.llm.common import bounded_batches
from spectralake.session import delete, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dedup.keep(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return suffix_dedup.clean(docs).where(F.length("text") > 0)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, kept=KEPT)


#: The executor's heap has grown in the stages before, so the encoder's workers remember less than on their own.
KEPT = 12_000_000
STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", tokens),
]
#: The estimates of the first stage are iterative, so SQL can't express the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        if i:
            delete(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
