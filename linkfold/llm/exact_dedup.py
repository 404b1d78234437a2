"""Exact de-duplication by skew-safe combining.

1. Local: Spark's partial aggregation on (digest, text) merges the copies inside each input
   partition before anything is shuffled.
2. Salted: digests with more than ``hot_count`` rows are merged per (digest, salt, text), so a
   text that is a third of all rows never meets in one task.
3. Global: the salt winners of a text, at most ``salts`` rows, are combined.

Every stage groups by the whole text next to its digest, so two texts that share a digest
stay two groups. Hot digests are found from the digests alone; at most ``max_hot`` of them
can exist (``hot_count`` is at least rows / ``max_hot``), which bounds their broadcast.

Cases: null text equals the empty text; rows equal in id and text are copies, one of them
stays; a null id loses against any other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import boxed, numbered, stored, texts


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_classes(rows: DataFrame, hot: DataFrame | None, salts: int) -> DataFrame:
    """``(_d, text, keep_id, group_size)``, one row per different text of ``rows(doc_id, text, _d)``."""
    best = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    if hot is None:
        return rows.groupBy("_d", "text").agg(*best)
    cold = rows.join(F.broadcast(hot), "_d", "left_anti").groupBy("_d", "text").agg(*best)
    salted = (rows.join(F.broadcast(hot), "_d", "left_semi")
              .withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("_d", "_salt", "text").agg(*best))
    winners = salted.groupBy("_d", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return cold.unionByName(winners)


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                     hot_count: int = 1_000, max_hot: int = 10_000,
                     salts: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the largest ``doc_id`` of each different text stays. ``digest`` only speeds
    the search up; any function of the text gives the same result.
    """
    rows = texts(docs).withColumn("_d", digest(F.col("text")))
    ids = numbered(rows.select("doc_id", "_d", sha256(F.col("text")).alias("_sha")), "dedup-ids")

    threshold = max(hot_count, -(-ids.count() // max_hot))
    hot = stored(ids.groupBy("_d").count().where(F.col("count") > threshold).select("_d"), "dedup-hot")
    classes = stored(text_classes(rows, None if hot.isEmpty() else hot, salts)
                     .withColumn("_sha", sha256(F.col("text"))).drop("text"), "dedup-classes")

    # a digest with one text decides its rows by digest; where a weak digest holds several texts,
    # the texts themselves are joined
    several = classes.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d")
    named = classes.select("_d", "keep_id", "group_size")
    if several.isEmpty():
        members = ids.join(named, "_d")
    else:
        several = stored(several, "dedup-several")
        plain = ids.join(several, "_d", "left_anti").join(named.join(several, "_d", "left_anti"), "_d")
        mixed = numbered(rows.join(several, "_d", "left_semi")
                         .withColumn("_sha", sha256(F.col("text"))), "dedup-mixed")
        apart = text_classes(mixed.select("doc_id", "text", "_d"), None, salts)
        full = mixed.join(apart, ["_d", "text"]).withColumn("_row", -1 - F.col("_row"))
        members = plain.unionByName(full.select(plain.columns))

    # of rows equal in id and text, one stays
    again = (members.groupBy("_sha", "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_row").alias("_last"))
             .where("_n > 1").select(F.col("_sha").alias("_s"), F.col("doc_id").alias("_i"), "_last"))
    out = members.join(again, (F.col("_sha") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left")
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))
         & F.coalesce(F.col("_row") == F.col("_last"), F.lit(True))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the copies: every column of the row that stays.

    The kept ids meet the rows by id and by the text's digest; of rows equal in both, one is kept.
    """
    found = stored(exact_duplicates(docs, **options), "dedup-found")
    kept = found.where("kept").select(F.col("doc_id").alias("_keep"), F.unhex("text_sha256").alias("_keep_sha"))
    mine = boxed(docs).withColumn("_sha", sha256(F.col("text"))).drop("text")
    joined = mine.join(kept, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_sha") == F.col("_keep_sha")))
    if not found.where("not kept and doc_id <=> keep_id").isEmpty():   # rows equal in id and text
        joined = joined.dropDuplicates(["doc_id", "_sha"])
    return joined.select("row.*")
