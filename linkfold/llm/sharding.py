"""Sharding by minimax contiguous partition: DataFrame functions only.

Documents with the same text are one atomic group and share a shard. Groups lie in the order of their text's digest, but
those above an even share of the bytes (fewer than ``shards`` of them) come first, as each fills a shard. One
range sort of narrow rows (the text itself is not shuffled) and a segmented prefix sum give every row the bytes and rows
before it. A shard is a contiguous piece of that order, so a sharding is a list of cuts between groups.

The smallest capacity for which ``shards`` pieces are enough is found by binary search, each capacity checked greedily (a
shard takes groups as long as they fit). A check needs only the last group boundary at or before a place, a few places
for each capacity. The driver keeps a bounded picture of the boundaries: the range in question is cut into ``cells`` cells,
one aggregation gives each cell's first and last boundary, and a capacity is decided if the places fall outside the cells'
insides. What is left undecided lies in a few cells, and the next aggregation cuts those. The stored rows are in the order
of the boundaries, so later aggregations read only the files of their range.

With the capacity found, the cuts are made as evenly as it allows: each shard ends at the boundary nearest to its even
share of what is left if the rest still fits, else at the greedy place. No shard is above the capacity, the
least possible, so a text that is a third of all bytes fills one shard and the others share the rest evenly.

Cases: a null text has no bytes (size 1) and is of the group of the empty text; rows with the same id or repeated rows count
one by one; fewer groups than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import boxed, numbered, stored, text_or_empty
from linkfold.operators.ordering import ordered, previous_row, running_totals


class Boundaries:
    """What the driver knows of the group boundaries, which lie between 0 and ``total``: some of them in order and, for each,
    whether there may be others before the next one."""

    def __init__(self, total: int):
        self.known, self.open = [0, total], [True, False]

    def floor(self, place: int) -> tuple[int, int]:
        """Bounds of the last boundary at or before ``place``; equal where it is known."""
        i = bisect_right(self.known, place) - 1
        least = self.known[i]
        return least, place if self.open[i] else least

    def after(self, place: int) -> int:
        """The first known boundary after ``place`` (the last one if there is none)."""
        return self.known[min(bisect_right(self.known, place), len(self.known) - 1)]

    def refine(self, lo: int, hi: int, found: list[tuple[int, int, int]]) -> None:
        """Add what lies strictly between the known boundaries ``lo`` and ``hi``: ``found`` has each cell's first and last boundary
        and their number, in order. Other boundaries can only be inside a cell, and only where they could be before."""
        i, j = bisect_left(self.known, lo), bisect_left(self.known, hi)
        known = sorted({*self.known[i:j], *(c[0] for c in found), *(c[1] for c in found)})
        firsts = [c[0] for c in found]
        spaces = []
        for at in known:
            k = bisect_right(firsts, at) - 1
            inside = k >= 0 and found[k][2] > 2 and at < found[k][1]
            spaces.append(inside and self.open[bisect_right(self.known, at) - 1])
        self.known[i:j], self.open[i:j] = known, spaces

    def undecided(self, lo: int, hi: int) -> int:
        return sum(self.open[bisect_left(self.known, lo):bisect_left(self.known, hi)])


def _chain(b: Boundaries, start: int, pieces: int, capacity: int, side: int) -> list[int]:
    """The greedy ends of ``pieces`` shards from ``start`` on: by the lower bounds (side 0) or the upper ones (side 1)."""
    ends, total = [], b.known[-1]
    for _ in range(pieces):
        start = total if start + capacity >= total else b.floor(start + capacity)[side]
        ends.append(start)
    return ends


def _least_capacity(b: Boundaries, pieces: int, side: int, lo: int, hi: int) -> int:
    """Binary search over ``(lo, hi]``; ``hi`` is known to be enough."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if _chain(b, 0, pieces, mid, side)[-1] == b.known[-1]:
            hi = mid
        else:
            lo = mid
    return hi


def _windows(b: Boundaries, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges as spans between known boundaries with unknown ones inside, merged where they overlap."""
    spans = []
    for lo, hi in ranges:
        i = bisect_right(b.known, max(0, lo)) - 1
        j = bisect_left(b.known, min(hi, b.known[-1]))
        while i < j and not b.open[i]:
            i += 1
        while j > i and not b.open[j - 1]:
            j -= 1
        if i < j:
            spans.append((b.known[i], b.known[j]))
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def _look(places: DataFrame, b: Boundaries, windows: list[tuple[int, int]], cells: int) -> None:
    """One aggregation over ``places(at)``: about ``cells`` rows reach the driver, and at least four for each undecided space."""
    number, inside, first = F.lit(None), F.lit(False), 0
    for lo, hi in windows:
        share = max(16, cells // len(windows), 4 * b.undecided(lo, hi))
        here = (F.col("at") > lo) & (F.col("at") < hi)
        number = F.when(here, F.expr(f"{first} + (at - {lo}) div {-(-(hi - lo) // share)}")).otherwise(number)
        inside, first = inside | here, first + share + 1
    found = (places.where(inside).groupBy(number.alias("cell"))
             .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")).collect())
    for lo, hi in windows:
        b.refine(lo, hi, sorted((r["lo"], r["hi"], r["n"]) for r in found if lo < r["lo"] < hi))


def _even_cuts(b: Boundaries, pieces: int, capacity: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The cuts, and the ranges in which a boundary that they rest on is not known."""
    total, start, cuts, unknown = b.known[-1], 0, [], []

    def fits(at: int, left: int) -> bool:
        for _ in range(left):
            if at + capacity >= total:
                return True
            low, high = b.floor(at + capacity)
            if low != high:
                unknown.append((at + capacity, at + capacity))
            at = low
        return at >= total

    for left in range(pieces, 1, -1):
        share = start + -(-(total - start) // left)
        limit = min(total, start + capacity)
        for place in (share, limit):
            if b.floor(place)[0] != b.floor(place)[1]:
                unknown.append((place, place))
        last = b.floor(limit)[0]
        near = sorted({x for x in (b.floor(share)[0], b.after(share)) if start < x <= limit}, key=lambda x: (abs(x - share), x))
        start = next((x for x in near if fits(x, left - 1)), last)
        cuts.append(start)
        if unknown:
            break
    return cuts, unknown


def minimax_cuts(places: DataFrame, total: int, shards: int, cells: int = 8192) -> tuple[int, list[int]]:
    """The least capacity and the ``shards - 1`` cuts for the group boundaries ``places(at)`` of ``total`` bytes."""
    b = Boundaries(total)
    if total == 0 or shards == 1:
        return total, [total] * (shards - 1)
    lo, hi = -(-total // shards) - 1, total
    while True:
        enough = _least_capacity(b, shards, 0, lo, hi)       # surely feasible
        least = _least_capacity(b, shards, 1, lo, enough)    # nothing below is
        if least == enough:
            break
        lo, hi = least - 1, enough
        starts = zip([0, *_chain(b, 0, shards, least, 0)], [0, *_chain(b, 0, shards, enough, 1)])
        _look(places, b, _windows(b, [(x + least, y + enough + 1) for x, y in starts if x < total]), cells)
    while True:
        cuts, unknown = _even_cuts(b, shards, enough)
        if not unknown:
            return enough, cuts
        _look(places, b, _windows(b, [(x, y + 1) for x, y in unknown]), cells)


def _large_groups(sized: DataFrame, shards: int) -> list:
    """Digests of the groups above an even share of what they and the smaller ones add up to, the largest first."""
    top = (sized.groupBy("_d").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "_d").limit(shards)).collect()
    left, large = sized.agg(F.sum("size")).first()[0] or 0, []
    for r in top:
        if r["n"] * (shards - len(large)) <= left or len(large) == shards - 1:
            break
        large.append(r["_d"])
        left -= r["n"]
    return large


def _placed(sized: DataFrame, shards: int) -> DataFrame:
    """``sized(doc_id, size, _d, _row, ...)`` in group order with the bytes ``_bytes`` and rows ``_rows`` before each row, and
    ``_begins`` where a group begins."""
    large, rank = _large_groups(sized, shards), F.lit(shards)
    for k, d in enumerate(large):
        rank = F.when(F.col("_d") == F.lit(d), k).otherwise(rank)
    t = previous_row(ordered(sized.withColumn("_rank", rank), ["_rank", "_d", "doc_id", "_row"]), ["_d"])
    totals = running_totals(t, {"_bytes": F.col("size"), "_rows": F.lit(1)})
    begins = F.col("_prev").isNull() | (F.col("_prev._d") != F.col("_d"))
    return stored(totals.withColumn("_begins", begins).drop("_prev", "_d", "_rank", "_mid", "_pid"), "shard-rows")


def _assigned(sized: DataFrame, shards: int, cells: int) -> DataFrame:
    rows = _placed(stored(sized, "shard-sizes"), shards)
    ends = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    places = rows.where("_begins").select(F.col("_bytes").alias("at"))
    _, cuts = minimax_cuts(places, ends["bytes"] or 0, shards, cells)

    def past(firsts: list[int], value: int | Column) -> Column:
        return sum((F.when(F.col("_bytes") >= c, 1).otherwise(0) for c in firsts), F.lit(value))

    # the rows before a shard are those before its first row; at most one row for each shard
    firsts = {r["shard"]: r["n"] for r in rows.groupBy(past(cuts, 0).alias("shard")).agg(F.min("_rows").alias("n")).collect()}
    before = F.element_at(F.array(*[F.lit(firsts.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard") + 1)
    return rows.withColumn("shard", past(cuts, 0).cast("int")).withColumn("slot", (F.col("_rows") - before).cast("long"))


def _size(text: Column) -> Column:
    return (F.octet_length(text) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = 8, cells: int = 8192) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per document: shards of nearly equal bytes. ``cells``
    bounds the rows that a search step sends to the driver."""
    text = text_or_empty()
    sized = docs.select("doc_id", _size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                        F.unhex(F.sha2(text, 256)).alias("_d"), F.monotonically_increasing_id().alias("_row"))
    return _assigned(sized, shards, cells).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, cells: int = 8192) -> None:
    """The whole rows as Parquet under ``path``, a folder ``shard=k`` for each shard (``_shard=k`` if the rows have such a column),
    in the order of their slots from file to file."""
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    rows = numbered(boxed(docs), "shard-docs")
    sized = rows.select("doc_id", _size(F.col("text")).alias("size"), F.unhex(F.sha2("text", 256)).alias("_d"), "_row")
    at = _assigned(sized, shards, cells).select(F.col("_row").alias("_at"), F.col("shard").alias("_to"), F.col("slot").alias("_slot"))
    whole = rows.select("row", "_row").join(at, F.col("_row") == F.col("_at"))
    (whole.repartitionByRange("_to", "_slot").sortWithinPartitions("_to", "_slot")
     .select("row.*", F.col("_to").alias(folder)).write.partitionBy(folder).parquet(path))
