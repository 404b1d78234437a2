"""Mixing sources to target weights by a low-discrepancy schedule.

* ``source_targets``: weights shared out over the sources, no source above ``cap`` times its size.
* Each source's documents, shuffled by a hash of their id, form one stream of words, read as
  often as the target asks. The stream is cut into blocks of ``block`` words.
* Slot ``k`` of the schedule is the golden-ratio point ``frac(k * phi)``, in whole numbers
  modulo 2^31. The point falls into one source's part of the cumulative weights; the ``r``-th slot of a
  source takes block ``r`` of its stream. Slots past a source's last block are left out; blocks
  that no slot has reached come after the schedule.

A source's words taken are its target rounded to whole words. No step gathers a source, or the rows of one id, in one task: the
stream offsets are prefix sums over range partitions, the slot ranks running totals over buckets (``running_total``).

Cases: a null source is a source of its own, last in order; a null text has size 0; a document
without words is never taken; an empty table gives an empty result; rows with the same id
count one by one, in the order of a hash of their texts, and a row without an id lies where that hash says, so only
rows equal in source, id and text can change places, and reruns over other partitions agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import SPACE_WORD, numbered, placed, running_total, stored
from linkfold.operators.ordering import ordered, row_index, running_totals

_MOD = 1 << 31                # the schedule's points are multiples of 1 / 2^31
_PHI = 1_327_217_885          # odd whole number nearest to 2^31 times the golden ratio's fraction
_CELLS = 4096                 # parts of the unit interval that points and sources meet in


def source_targets(sources: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """``sources(sid, source, source_size)`` with ``weight`` and ``target``.

    Source ``sid`` weighs ``weights[sid % len(weights)]``. The targets add up to ``share`` times all sizes
    (or to ``cap`` times, if that is less); where a share would pass ``cap`` times the source's size, it
    stops there and the rest is shared again. Each pass is one aggregation, and a pass that
    stops no further source ends the loop.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("sid") % len(weights) + 1).cast("int"))
    table = sources.withColumn("weight", weight).withColumn("_cap", cap * F.col("source_size"))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    goal, level, stopped = share * total, 0.0, -1
    while True:
        full = F.col("_cap") <= level * F.col("weight")
        row = table.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("_cap"))).alias("taken"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (goal - (row["taken"] or 0.0)) / row["open"]
    if not row["open"]:
        level = math.inf
    return table.withColumn("target", F.least("_cap", level * F.col("weight")) if math.isfinite(level)
                            else F.col("_cap")).drop("_cap")


@dataclass
class Mix:
    """``documents``: one row each, with its words ``taken``, the ``first_slot`` that takes some (null if none does) and
    its ``n_blocks``; ``pieces``: the mix in the order ``slot, at``, as ``slot, at, sid, block, _row, doc_id, size, pass, from_word,
    to_word`` (words of the document, ``to_word`` exclusive; ``at`` is the place in the block)."""
    documents: DataFrame
    pieces: DataFrame


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0,
                block: int = 1024, seed: int = 42, max_buckets: int = 4096,
                row_col: str | None = None) -> Mix:
    """Plan the mix of ``docs(doc_id, text, source)``; see the module text.

    ``block`` is the words per slot. ``max_buckets`` bounds the rows of one window of slot totals.
    ``row_col`` names a column of unique row numbers, if ``docs`` has one.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(*([F.col(row_col).alias("_given")] if row_col else []), "doc_id", "source",
                        F.regexp_count(text, F.lit(SPACE_WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_t"))
    sized = numbered(sized.withColumn("_h", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed)))
                                      .otherwise(F.xxhash64("_t", F.lit(seed)))), "mix-docs")
    if row_col:
        sized = sized.withColumn("_row", F.col("_given")).drop("_given")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_index(by_source.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "sid").drop("_last")
    targets = stored(source_targets(ranked, weights, share, cap)
                     .withColumn("_words", F.round("target").cast("long"))
                     .withColumn("_blocks", F.ceil(F.col("_words") / F.lit(block)).cast("long")), "mix-targets")
    sums = targets.agg(F.sum("target").alias("t"), F.sum("_blocks").alias("b")).first()
    total, n_slots = sums["t"] or 0.0, sums["b"] or 0

    # the sources' streams, shuffled: in the order of the hash
    docs_s = (sized.join(targets.select(F.col("source").alias("_s"), "sid", "source_size", "target", "_words"),
                         F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    stream = stored(running_totals(ordered(docs_s, ["sid", "_h", "doc_id", "_t", "_row"]), {"_at": F.col("size")}, ["sid"])
                    .drop("_mid", "_pid"), "mix-stream")
    passes = math.ceil(cap)
    spans = (stream.where("size > 0")
             .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
             .withColumn("_from", F.col("_at") + F.col("pass") * F.col("source_size"))
             .withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_words")))
             .where("_to > _from"))
    in_blocks = (spans.withColumn("block", F.explode(F.sequence(
                     F.floor(F.col("_from") / block).cast("long"), F.floor((F.col("_to") - 1) / block).cast("long"))))
                 .withColumn("from_word", F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("_from")))
                 .withColumn("to_word", F.least(F.col("_to"), (F.col("block") + 1) * block) - F.col("_from"))
                 .withColumn("at", F.col("_from") + F.col("from_word") - F.col("block") * block))

    slots = schedule(targets, total, n_slots, max_buckets)
    pieces = in_blocks.join(slots, ["sid", "block"]).select(
        "slot", "at", "sid", "block", "_row", "doc_id", "size", "pass", "from_word", "to_word")
    taken = pieces.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"),
                                       F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("_blocks"))
    documents = stream.join(taken, "_row", "left").select(
        "_row", "doc_id", "source", "size", "source_size", "target",
        F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_slot",
        F.coalesce("_blocks", F.lit(0)).cast("long").alias("n_blocks"))
    return Mix(documents, pieces)


def schedule(targets: DataFrame, total: float, n_slots: int, max_buckets: int = 4096) -> DataFrame:
    """``(sid, block, slot)``: which slot takes which block. Every block of every source occurs once."""
    spark = targets.sparkSession
    need = targets.where("_blocks > 0").select("sid", "target", "_blocks")
    # a source's part of the cumulative weights, in whole points; sources meet points in cells, so the
    # number of sources is free and nothing is broadcast by need
    parts = running_total(need.withColumn("_one", F.lit(0)).withColumn("_b", F.floor(F.col("sid") / max_buckets)),
                          "_one", "_b", ["sid"], "target", "_cum")
    point = lambda c: F.floor(c / F.lit(total or 1.0) * _MOD).cast("long")
    parts = (parts.select("sid", point(F.col("_cum")).alias("_lo"), point(F.col("_cum") + F.col("target")).alias("_hi"))
             .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / (_MOD // _CELLS)),
                                                       F.floor(F.col("_hi") / (_MOD // _CELLS))))))
    drawn = (spark.range(n_slots).withColumnRenamed("id", "slot")
             .withColumn("_u", (F.col("slot") % _MOD) * _PHI % _MOD)
             .withColumn("_cell", F.floor(F.col("_u") / (_MOD // _CELLS)))
             .join(parts, "_cell").where("_u >= _lo and _u < _hi")
             .select("slot", "sid", F.lit(1).alias("_one"),
                     F.floor(F.col("slot") / max(1, n_slots // max_buckets)).alias("_b")))
    ranked = running_total(drawn, "sid", "_b", ["slot"], "_one", "block")
    used = ranked.join(need.select("sid", "_blocks"), "sid").where("block < _blocks").select("sid", "block", "slot")
    drawn_n = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"))
    n_sources = targets.count()
    short = (need.join(drawn_n, "sid", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
             .where("_n < _blocks")
             .select("sid", F.explode(F.sequence(F.col("_n"), F.col("_blocks") - 1)).alias("block"))
             .select("sid", "block", (n_slots + F.col("block") * n_sources + F.col("sid")).alias("slot")))
    return used.unionByName(short)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: whole rows, each as often as the words taken from it fill it (rounded;
    only the document at which a source's target ends is taken in part), in the order of the slots at which the
    copies begin: range-partitioned, and sorted in each partition. A row without words goes.

    The plan of the mix is made on narrow rows and joined to the texts by their places, so no copy of them is stored."""
    rows = placed(docs, "mix-rows")
    pieces = mix_sources(rows, row_col="_place", **options).pieces
    # a pass reads a document from its first word on; it gives a copy if it takes half of the words or more
    copies = (pieces.groupBy(F.col("_row").alias("_copy_of"), "pass").agg(
        F.min(F.struct("slot", "at")).alias("_to"), F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"), F.min("size").alias("_size"))
        .where("2 * _taken >= _size").select("_copy_of", "_to"))
    return (rows.select("row", "_place").join(copies, F.col("_place") == F.col("_copy_of"))
            .repartitionByRange("_to").sortWithinPartitions("_to").select("row.*"))
