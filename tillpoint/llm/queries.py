"""The thin ``opN_<name>`` queries and, where SQL can express the result, their SQL.

Each query applies its operator to the whole table with production parameters and
derives digest columns from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import (context_coder, cutting_stock, exact_dedup, hilbert_search, hyperminhash, imatch,
                           merkle, ordinal_quality, prefix_trie, sharding, toxicity, unigram, warc_store)
from tillpoint.llm.common import shared_folder, table

N_SHARDS = 16


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op2_context_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-ids")
    context_coder.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return context_coder.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = cutting_stock.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.digests()


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def ratings(labels: DataFrame) -> DataFrame:
    """Three grades from the labels: 0 junk, 1 prose that is toxic, 2 clean prose."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = ordinal_quality.fit(documents, ratings(table(spark, sf_dir, "labels")), grades=3)
    return ordinal_quality.score(documents, model)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_groups(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op9_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.read_records(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to")


def op10_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = unigram.load_model(public_tokenizers.path("piece_bpe_32k.model"), zipf=True)
    decoded = unigram.decode(unigram.encode(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_pieces"),
                          F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"),
                          (F.col("decoded") == F.col("text")).alias("round_trip"))


def op11_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def manifest_digests(manifest: DataFrame) -> DataFrame:
    folded = manifest.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("proof")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                         merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digests(merkle.documents_manifest(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_context_coder": op2_context_coder,
    "op3_cutting_stock_packing": op3_cutting_stock_packing,
    "op4_weak_toxicity": op4_weak_toxicity,
    "op5_rendezvous_sharding": op5_rendezvous_sharding,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_warc_store": op9_warc_store,
    "op10_unigram": op10_unigram,
    "op11_hilbert_search": op11_hilbert_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op7_exact_dedup": """
WITH whole AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
grp AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM whole GROUP BY body)
SELECT w.doc_id, g.keep_id, g.group_size, w.doc_id = g.keep_id AS kept, sha256(w.body) AS text_sha256
FROM whole w JOIN grp g ON w.body = g.body""",
    "op9_warc_store": """
WITH rec AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
first AS (SELECT body, min(page_id) AS first_id FROM rec GROUP BY body)
SELECT r.page_id, octet_length(encode(r.body)) AS payload_bytes, sha256(r.body) AS payload_digest,
       CASE WHEN octet_length(encode(r.body)) >= 100 AND r.page_id <> f.first_id THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(r.body)) >= 100 AND r.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM rec r JOIN first f ON r.body = f.body""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
