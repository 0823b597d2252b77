"""The opN queries: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, mixing, packing, quality, rules, secrets, sharding, simhash, topk, warc
from .common import materialize, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.fit_model(docs))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs)).select(F.col("id").alias("doc_id"), "kept", "score", "weak_label")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), at)
    # written once: the assembly reads the records three times, and none needs the payloads
    records = materialize(warc.verified(warc.read_records(spark, at)), "records")
    got = warc.assemble(records)
    revisit = F.col("response.kind") == "revisit"
    return got.select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(revisit, F.col("metadata.payload_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.substring_index("response.d", ":", -1).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(revisit, F.col("response.refers_page")).alias("refers_to"),
        (revisit | F.col("response.intact")).alias("intact"),
    )


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
    return out.withColumnsRenamed({"id": "doc_id", "sequence": "sequence_id"})


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_html": op8_html,
    "op9_rules": op9_rules,
    "op10_mixing": op10_mixing,
}
