"""A corpus pipeline of five operators: quality rules, near-duplicates, repeated passages, secrets, packing.

Null, empty and blank texts have no words and go with the first stage. Rows of a null id stay, as documents
of their own, after all others in the order of ids; rows alike in id and text are one document after the second stage, unlike texts
of one id are documents of their own. Texts of any length are taken whole. Other columns, whatever their
names, are carried along, but for the last stage, whose rows are pieces. An empty table gives no rows; without
labels every document that passes the base rules is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import dart_minhash, line_crf, packing, secret_ownership, suffix_dedup
from emberline.llm._common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are mostly boilerplate lines."""
    return line_crf.keep(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return dart_minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that occur earlier out of the texts."""
    return suffix_dedup.remove(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that only one owner holds."""
    return secret_ownership.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: a row for each piece, with its token ids, and the text on a document's first piece."""
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]

#: The stages train, sketch and sort suffixes: no SQL states them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is checkpointed in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
