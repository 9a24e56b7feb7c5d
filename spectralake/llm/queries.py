"""The thin queries of this subpackage: each applies one operator to its whole table and keeps the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.llm import bpe, decontaminate, html_text, language_id, near_dedup, ngram_join, quality_net, quality_rules, spelling, substring_dedup, suffix_dedup, url_filters, vector_codes
from spectralake.llm.common import bounded_batches, crc_bucket
from spectralake.session import table

# The rules of op9.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    documents, fold = table(spark, sf_dir, "documents"), crc_bucket("doc_id", 4)
    net = quality_net.train(documents, table(spark, sf_dir, "labels"), fold != 2)
    out = quality_net.scored(documents, net, ["doc_id"])
    return out.select("doc_id", (fold == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return substring_dedup.remove(table(spark, sf_dir, "documents"), keep_text=False)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dedup.group(table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    documents, fold = table(spark, sf_dir, "documents"), crc_bucket("doc_id", 5)
    model = language_id.train(documents, fold != 0)
    return language_id.identified(documents, model, ["doc_id"]).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ngram_join.group(table(spark, sf_dir, "documents"), k=3, percent=90)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_net": op2_quality_net,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_vector_codes": op13_vector_codes,
}
