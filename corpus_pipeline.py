"""A corpus pipeline: documents to training tokens, each stage one operator over all that its predecessor kept.

The stages drop what the language identifier rejects, keep one document of each group of near copies, drop documents that
hold a benchmark item, replace secrets by a mark, and encode what is left. All but the last return the columns of documents.
An empty table passes through as an empty table; columns beyond those of documents stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, common, decontaminate, language, near_copies, secret_scan

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. Those without letters (null and empty texts among them) or without a likely language go;
    rows are told apart by id and text, so null and repeated ids cost no other row."""
    return language.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (null ids last); a row that repeats whole stays
    once. Texts without words are copies of each other."""
    return near_copies.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Only the row whose own text has one goes, also among null and repeated ids; null
    and empty texts, and an empty benchmark, remove nothing."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars counted anew. Null texts stay null."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; null and empty texts have no tokens."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.round_trip(docs, ranks)).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can't express trigram models, verified near copies or merges of byte pairs; a test compares run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table. Every stage's result is written and read again; then its input
    and what it wrote on the way are deleted."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.settle_stage(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        common.done(before)
    return docs
