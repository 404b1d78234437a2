"""Per-key statistics and the hot/cold split that keeps every round skew-safe.

One key may hold a large share of all rows: the root of a giant component is a
neighbour of every node in it. Such a key must never be clustered into one task.

* ``key_stats`` is a plain ``groupBy(key).agg(min, count)``: partial aggregation collapses
  a hub to one row per map task before anything is shuffled.
* Keys with more than ``threshold`` rows are *hot*. There are at most
  ``n_rows / threshold`` of them (pigeonhole), and ``hot_threshold`` picks the threshold so
  that bound is ``max_hot_keys``. That proven bound is what makes it safe to broadcast
  the hot keys: their rows are matched map-side, in place, without a shuffle.
* Every other (cold) key has at most ``threshold`` rows, so any grouping, window or array
  built per cold key is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_HOT_KEYS = 100_000     # broadcast bound: 100k rows of (id, id) is a few MB
DEFAULT_MIN_HOT_DEGREE = 100_000   # a key below this is never treated as hot


def key_stats(df: DataFrame, key: str = "n1", value: str = "n2") -> DataFrame:
    """``(key, mn, deg)``: minimum value and row count per key."""
    return df.groupBy(key).agg(F.min(value).alias("mn"), F.count(F.lit(1)).alias("deg"))


def hot_threshold(n_rows: int, *, hot_degree: int | None = None,
                  min_hot_degree: int = DEFAULT_MIN_HOT_DEGREE,
                  max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> int:
    """Degree above which a key is hot, such that at most ``max_hot_keys`` keys are.

    An explicit ``hot_degree`` is accepted only if the same bound still holds for it.
    """
    if max_hot_keys < 1:
        raise ValueError("max_hot_keys must be positive")
    floor = max(1, math.ceil(n_rows / max_hot_keys))
    if hot_degree is not None:
        if hot_degree < floor:
            raise ValueError(
                f"hot_degree={hot_degree} could make up to {n_rows // max(hot_degree, 1)} keys hot; "
                f"the broadcast budget is {max_hot_keys} keys (need hot_degree >= {floor})")
        return hot_degree
    return max(min_hot_degree, floor)


def split_hot(df: DataFrame, stats: DataFrame, key: str, threshold: int,
              hot_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys (joined map-side to their stats columns) and rows of cold keys.

    ``stats`` must hold one row per key with a ``deg`` column; the hot part of it is
    bounded by ``n_rows / threshold`` rows (see ``hot_threshold``) and is broadcast.
    """
    hot = stats.where(F.col("deg") > threshold).select(key, *(hot_cols or []))
    hot_rows = df.join(F.broadcast(hot), key)
    cold_rows = df.join(F.broadcast(hot.select(key)), key, "left_anti")
    return hot_rows, cold_rows


def attach_group_min(df: DataFrame, key: str, value: str, out: str = "mn",
                     cold: str = "window", n_rows_bound: int | None = None,
                     **threshold_opts) -> DataFrame:
    """``df`` plus the minimum ``value`` of the row's ``key`` group, next to every row.

    Hot groups get it from the broadcast stats; cold groups from a window over the key
    (``cold='window'``) or a shuffle join with the stats (``cold='join'``). The threshold
    is sized from ``n_rows_bound`` (any upper bound on the row count keeps the bound on
    the number of hot keys), else from ``df.count()``.
    """
    stats = key_stats(df, key, value)
    n_rows = df.count() if n_rows_bound is None else n_rows_bound
    threshold = hot_threshold(n_rows, **threshold_opts)
    hot_rows, cold_rows = split_hot(df, stats, key, threshold, ["mn"])
    hot_part = hot_rows.select(*df.columns, F.col("mn").alias(out))
    if cold == "window":
        from pyspark.sql import Window
        cold_part = cold_rows.select(*df.columns, F.min(value).over(Window.partitionBy(key)).alias(out))
    elif cold == "join":
        cold_stats = stats.where(F.col("deg") <= threshold).select(key, F.col("mn").alias(out))
        cold_part = cold_rows.join(cold_stats, key).select(*df.columns, out)
    else:
        raise ValueError(f"unknown cold path {cold!r}")
    return hot_part.unionByName(cold_part)
