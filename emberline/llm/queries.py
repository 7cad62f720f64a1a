"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantisation, bpe_trie, dart_minhash, line_block, line_crf, noisy_channel, packing, secret_ownership, suffix_dedup, url_rules
from ._common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return noisy_channel.score(docs, noisy_channel.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantisation.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_line_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_block.extract(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.digests(table(spark, sf_dir, "documents"))


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_trie.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and n_links of each document."""
    return dart_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_quality_crf, op3_packing, op4_additive_quantisation, op5_url_rules, op6_suffix_dedup, op7_line_block, op8_secrets, op9_bpe_trie, op10_dart_minhash)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": url_rules.oracle(), "op10_dart_minhash": dart_minhash.oracle()}
