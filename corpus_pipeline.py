"""The corpus pipeline: language ID, exact de-duplication, near de-duplication, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkfold.llm import exact_dedup, langid, mixing, packing, queries, simhash
from linkfold.llm.common import read_documents
from linkfold.storage import drop_path, new_scratch_path, scratch, write_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language ID finds a language stay: it rejects texts without a letter, and those in which hardly any
    n-gram is near its place in any profile."""
    return langid.known_language(docs, min_score=0.05)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each different text stays, the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id: 4-word shingles, 4 bits or fewer apart.
    Every row is a document, as in the other stages, whatever its id."""
    return simhash.drop_near_duplicates(docs, width=4, max_bits=4, rows_apart=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the source mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents packed into sequences of at most 2048 tokens: one row per piece."""
    return packing.pack_documents(docs, queries.BYTE_BPE, end_id=0, capacity=2048)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]

#: no stage but exact de-duplication can be said in SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_scratch_path(spark, f"stage-{name}")
        with scratch(spark):   # what the stage has stored goes with it
            docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
