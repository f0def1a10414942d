"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, decontaminate, language, main_text, media, secret_scan, sharding, simhash, warc, wavelet

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(common.read(spark, sf_dir, "documents"))

    def text(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secret_scan.BASE)
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    ranks = byte_bpe.read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.round_trip(common.read(spark, sf_dir, "documents"), ranks)).withColumnRenamed("id", "doc_id")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extract(common.read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The end id that op4 appends to each document.
END_ID = 2


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    with open(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        json = f.read()
    path = common.scratch(spark, "tokens")
    wavelet.write(common.read(spark, sf_dir, "documents"), path, json, END_ID)
    back = wavelet.read(spark.read.parquet(path))
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(common.read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(common.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "lang", F.round("posterior", 6).alias("posterior"), "keep")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all its evidence exists: pages with markup, address and host."""
    model = language.learn(common.read(spark, sf_dir, "documents"))
    pages = language.page_rows(common.read(spark, sf_dir, "pages"))
    found = language.identify(pages, model, "page_id", "text", "declared", "url", None)
    return found.select(F.col("id").alias("page_id"), "lang", F.round("posterior", 6).alias("posterior"), "keep")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(common.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write(common.read(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path)
    return back.select(F.col("row").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.settle(media.encode(common.read(spark, sf_dir, "documents")), "media")
    back = media.read_back(stored)
    return back.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{media.ROW}, {media.ROW})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_main_text": op3_html_main_text,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "language_id_pages": language_id_pages,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_warc": op9_warc,
    "op10_media_columns": op10_media_columns,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_extendible_sharding": sharding.ORACLE_SQL,
    "op6_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
        r AS (SELECT *, coalesce(payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first, false) AS again FROM f)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to
        FROM r""",
}
