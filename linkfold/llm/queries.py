"""The registered queries of this package, ``name -> (spark, sf_dir) -> DataFrame``, over the whole ``documents`` (or
``conversations``) table with production parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm import (conversations, exact_dedup, filter_audit, langid, licenses, mixing, packing, rans, sharding, simhash,
                          sketches, suffix_dedup, token_counts)
from linkfold.llm.common import read_documents, read_table
from linkfold.storage import new_scratch_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), BYTE_BPE, end_id=0, capacity=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "token-files")
    rans.write_token_files(read_documents(spark, sf_dir), path, BYTE_BPE, end_id=2)
    return rans.token_index(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir), WORD_BPE, limit=2048)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir), width=4, max_bits=4)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(read_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_documents(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_documents(spark, sf_dir)).documents.select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "n_blocks")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_documents(spark, sf_dir), window=200).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_documents(spark, sf_dir), shards=8)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    repair = conversations.repair_conversations(conversations.damaged(rows))
    digests = conversations.repaired_digests(repair.turns).withColumnRenamed("conv", "_conv")
    every = rows.select("conv_id", F.col("conv_id").cast("string").alias("_id")).distinct()
    found = (every.join(repair.conversations, F.col("_id").eqNullSafe(F.col("conv")), "left")
             .join(digests, F.col("_id").eqNullSafe(F.col("_conv")), "left"))
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_token_files, op3_token_counts, op4_simhash_near_dedup,
    op5_document_fingerprints, op6_language_id, op7_license_scan, op8_source_mix, op9_exact_dedup, op10_suffix_dedup,
    op11_sharding, op12_conversation_repair, op13_filter_audit)}

SQL: dict[str, str] = {
    "op7_license_scan": licenses.scan_sql(),
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window same as (partition by coalesce(text, ''))
    """,
    "op13_filter_audit": filter_audit.audit_sql(),
}
