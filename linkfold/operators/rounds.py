"""One round of the component algorithm, with four interchangeable physical strategies.

Semantics (set semantics throughout). ``S`` is the mirrored pair set. For every key ``k``
with ``m = min(S[k]) < k``: emit ``(k, m)`` and ``(v, m)`` for each other value ``v``;
then de-duplicate. ``new_pairs`` is the number of ``(v, m)`` rows, which is
``sum(deg(k) - 1)`` over those keys because the mirrored set has no repeats.

Physical plan of a round
------------------------
1. ``key_stats(S)``: min and degree per key, partially aggregated (hub-safe). The caller
   materialises it once and reads ``new_pairs`` and ``|S|`` from it in one action.
2. Hot keys (degree above the threshold; a bounded set) are matched map-side against
   the broadcast stats: their rows never move.
3. Cold keys run through the chosen strategy; none holds a group in memory:

   ``join``     stats joined back to the rows; rows are streamed past one stats row
   ``collect``  neighbour sets of constant size per key, explode, relabel by the key's min
   ``sorted``   the same sets sorted; the head that is the min, then the tails
   ``window``   min over a window partitioned by key, then relabel
4. Union, ``distinct`` (partial de-dup before the shuffle).

``join`` is the default: it builds no sets and sorts no windows. The others exist because they are
part of the analysed workload; they give identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkfold.operators.keyed import hot_threshold, key_stats, split_hot
from linkfold.operators.pairs import mirror_distinct, mirror_explode, relabel_case

STRATEGIES = ("join", "collect", "sorted", "window")
LIST_SIZE = 1024   # ids of a neighbour set in the 'collect' and 'sorted' strategies, about (dealt by hash)


def mirror(g: DataFrame, first_round: bool) -> DataFrame:
    """The map step. After round one every pair has ``n1 > n2``, so a pair set and its
    reverse cannot overlap: both directions come from one scan, with no de-duplication."""
    return mirror_distinct(g) if first_round else mirror_explode(g)


def round_stats(s: DataFrame) -> DataFrame:
    """``(n1, mn, deg)`` for every key of the mirrored set."""
    return key_stats(s, "n1", "n2")


def stats_summary(stats: DataFrame) -> tuple[int, int, int]:
    """``(new_pairs, mirrored_rows, max_degree)`` in one aggregate action over the stats."""
    row = stats.agg(
        F.sum(F.when(F.col("mn") < F.col("n1"), F.col("deg") - 1)).alias("new_pairs"),
        F.sum("deg").alias("rows"), F.max("deg").alias("max_deg")).first()
    return int(row["new_pairs"] or 0), int(row["rows"] or 0), int(row["max_deg"] or 0)


def _cold_join(s: DataFrame, qual: DataFrame) -> DataFrame:
    joined = s.join(qual.select("n1", "mn"), "n1")
    tails = joined.where(F.col("n2") != F.col("mn")).select(
        F.col("n2").alias("n1"), F.col("mn").alias("n2"))
    heads = qual.select("n1", F.col("mn").alias("n2"))
    return tails.union(heads)


def _bounded_sets(s: DataFrame, qual: DataFrame) -> DataFrame:
    """``(n1, mn, nbrs)``: the neighbours of each qualifying key in sets of about ``LIST_SIZE`` ids, whatever its degree.
    The parts are dealt by a hash of the value, on the key's own partitioning: no second shuffle."""
    part = F.pmod(F.xxhash64("n2"), F.ceil(F.col("deg") / LIST_SIZE))
    return (s.join(qual.select("n1", "mn", "deg"), "n1").groupBy("n1", "mn", part.alias("_part"))
            .agg(F.collect_set("n2").alias("nbrs")))


def _cold_collect(s: DataFrame, qual: DataFrame) -> DataFrame:
    return (_bounded_sets(s, qual).select("n1", "mn", F.explode("nbrs").alias("v"))
            .select(relabel_case(F.col("n1"), F.col("mn"), F.col("v")).alias("n1"), F.col("mn").alias("n2")))


def _cold_sorted(s: DataFrame, qual: DataFrame) -> DataFrame:
    # the head of the set that holds the minimum becomes (key, min); every other value becomes (value, min)
    return (_bounded_sets(s, qual).select("n1", "mn", F.posexplode(F.sort_array("nbrs")).alias("pos", "v"))
            .select(F.when((F.col("pos") == 0) & (F.col("v") == F.col("mn")), F.col("n1")).otherwise(F.col("v")).alias("n1"),
                    F.col("mn").alias("n2")))


def _cold_window(s: DataFrame, qual: DataFrame) -> DataFrame:
    withmin = s.select("n1", "n2", F.min("n2").over(Window.partitionBy("n1")).alias("mn"))
    return (withmin.where(F.col("mn") < F.col("n1"))
            .select(relabel_case(F.col("n1"), F.col("mn"), F.col("n2")).alias("n1"),
                    F.col("mn").alias("n2")))


_COLD = {"join": _cold_join, "collect": _cold_collect,
         "sorted": _cold_sorted, "window": _cold_window}


def round_output(s: DataFrame, stats: DataFrame, strategy: str, threshold: int,
                 dedup: bool = True, max_degree: int | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """The pairs a round emits (de-duplicated unless ``dedup=False``; then in ``num_partitions``, if given).

    With ``max_degree <= threshold`` (known from the stats action) no key is hot and the
    broadcast side is left out of the plan altogether.
    """
    if strategy not in _COLD:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    if max_degree is not None and max_degree <= threshold:
        cold_q = stats.where(F.col("mn") < F.col("n1"))
        return _deduplicated(_COLD[strategy](s, cold_q), dedup, num_partitions)
    hot_rows, cold_rows = split_hot(s, stats, "n1", threshold, ["mn"])
    hot_q = stats.where((F.col("deg") > threshold) & (F.col("mn") < F.col("n1")))
    hot_out = (hot_rows.where((F.col("mn") < F.col("n1")) & (F.col("n2") != F.col("mn")))
               .select(F.col("n2").alias("n1"), F.col("mn").alias("n2"))
               .union(hot_q.select("n1", F.col("mn").alias("n2"))))
    cold_q = stats.where((F.col("deg") <= threshold) & (F.col("mn") < F.col("n1")))
    return _deduplicated(hot_out.union(_COLD[strategy](cold_rows, cold_q)), dedup, num_partitions)


def _deduplicated(pairs: DataFrame, dedup: bool, num_partitions: int | None) -> DataFrame:
    if not dedup:
        return pairs
    # dealing by both ids is what distinct() needs, so a given partition count costs no second shuffle
    return (pairs.repartition(num_partitions, "n1", "n2") if num_partitions else pairs).distinct()


def cc_round(g: DataFrame, strategy: str = "join", *, first_round: bool = True,
             dedup: bool = True, **threshold_opts) -> DataFrame:
    """One round on pair table ``g(n1, n2)``, as a lazy DataFrame.

    Runs one scan (no shuffle) to size the hot-key threshold: ``2 * |g|`` bounds the
    mirrored set from above, which keeps the bound on the number of hot keys. The loop
    (``iterate``) reads the exact size and the largest degree from its stats instead.
    """
    s = mirror(g, first_round)
    stats = round_stats(s)
    return round_output(s, stats, strategy, hot_threshold(2 * g.count(), **threshold_opts),
                        dedup=dedup)
