"""Hash-threshold sampling: the ``k`` rows with the least hash, found by a bound instead of a top-k.

A top-k of ``n`` rows makes every partition send ``k`` of them to one place. Here the range of the hash is counted in cells (one
aggregation, at most ``cells`` rows to the driver), the bound is the end of the cell in which the ``k``-th row lies, and
if that cell holds many rows beyond it, it is counted again in finer cells. About ``k`` rows are below the bound, whatever
the number of partitions; the exact ``k`` are cut from those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bound(df: DataFrame, hashed: Column, k: int, lo: int, hi: int, cells: int = 4096, slack: float = 0.1) -> int | None:
    """A number such that at least ``k`` rows have a hash at or below it, and at most ``(1 + slack) * k`` if the hash tells the rows
    apart; None if ``df`` has at most ``k`` rows. ``hashed`` is a whole number from ``lo`` to ``hi``."""
    below = 0   # rows before lo
    first = True
    while True:
        width = -(-(hi - lo + 1) // cells)
        # subtraction in decimals: a range of 64 bits does not fit a long
        cell = F.floor((hashed.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        rows = (df.where((hashed >= lo) & (hashed <= hi)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
        if first and sum(r["n"] for r in rows) <= k:
            return None
        first = False
        for r in sorted(rows, key=lambda r: r["cell"]):
            if below + r["n"] >= k:
                lo, hi = lo + r["cell"] * width, min(hi, lo + (r["cell"] + 1) * width - 1)
                break
            below += r["n"]
        if width == 1 or below + r["n"] <= (1 + slack) * k:
            return hi


def least_by_hash(df: DataFrame, hashed: Column, k: int, lo: int, hi: int, ties: list[str], **options) -> DataFrame:
    """The ``k`` rows with the least ``hashed``, ties by the columns ``ties``."""
    bound = hash_bound(df, hashed, k, lo, hi, **options)
    kept = df if bound is None else df.where(hashed <= bound)
    return kept.orderBy(hashed, *ties).limit(k)
