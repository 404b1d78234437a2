"""Star rounds over pairs that stay grouped by their greater id: the rows of ``rounds``, with about half of their shuffles.

Every pair is stored once, as ``(n1, n2, mn)`` with ``n2 <= n1`` and ``mn`` the least neighbour of ``n1`` that is stored with it, so no
minimum has to be joined to the rows of ``n1`` and the mirrored set is never made. A node is *low* if it is the least of its closed
neighbourhood; it emits nothing. What the others emit in a round is

* for every row ``(n1, n2, mn)`` one pair without any shuffle: ``(n1, mn)`` where ``n2`` is the minimum, else ``(n2, mn)``;
* for every row whose ``n2`` is not low itself, ``(n1, m)`` with the minimum ``m`` of ``n2``: one join, over ``inner_nodes``.

These are all ``(key, min)`` and ``(value, min)`` rows of the round: the first kind are those of key ``n1`` to its lesser
neighbours, the second those of key ``n2`` to its greater ones. Repeats are taken out before the shuffle task by task, and after it by one sort.

Rows of a hot ``n2`` are matched map-side. A hot ``n1`` (very many *lesser* neighbours) is what this layout does not spread:
``group_pairs`` reports the most rows of one ``n1``, and the loop goes on with the rounds of ``rounds`` if that is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from linkfold.operators.keyed import hot_threshold, split_hot
from linkfold.storage import write_table

COMBINED_ROWS = 1_000_000   # rows of a task that are de-duplicated together before the shuffle
TASK_ROWS = 1_500_000       # rows that one task sorts, about
HOT_DEGREE = 256            # an n2 with more rows is matched map-side; doubled until at most MAX_HOT_KEYS are
MAX_HOT_KEYS = 500_000      # broadcast bound: a pair of ids each, 16 MB and its hash table


def _once(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows in the order of their ids, in which a shuffle's blocks compress best."""
    rows = pa.Table.from_batches(batches)
    once = rows.group_by(rows.column_names, use_threads=False).aggregate([])
    yield from once.sort_by([("n2", "ascending"), ("n1", "ascending")]).to_batches(max_chunksize=100_000)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= COMBINED_ROWS:
            yield from _once(held)
            held, n = [], 0
    if n:
        yield from _once(held)


def group_pairs(pairs: DataFrame, path: str, n_rows: int | None = None, num_partitions: int | None = None) -> tuple[DataFrame, dict]:
    """Write ``pairs(n1, n2)``, ``n2 <= n1``, without repeats as ``(n1, n2, mn)`` at ``path``, all rows of an ``n1`` in one task.

    The second value counts ``rows``; ``heads``, the ``n1`` above their ``mn``, and ``emitted``, the rows of these; ``most``, the
    most rows of one ``n1`` that met in a task. ``n_rows`` bounds the rows and sizes the tasks (unknown: Spark's own partitions).
    """
    once = pairs.mapInArrow(_combined, pairs.schema)
    if num_partitions is None and n_rows and n_rows > TASK_ROWS * pairs.sparkSession.sparkContext.defaultParallelism:
        num_partitions = -(-n_rows // TASK_ROWS)
    dealt = once.repartition(num_partitions, "n1") if num_partitions else once.repartition("n1")
    seq = Window.partitionBy("n1").orderBy("n2")
    above = F.col("mn") < F.col("n1")
    seen = Observation()   # counted while the table is written
    out = (dealt.select("n1", "n2", F.first("n2").over(seq).alias("mn"), F.lag("n2").over(seq).alias("_prev"),
                        F.row_number().over(seq).alias("_at"))
           .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("n2")))
           .observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(above, 1)).alias("emitted"),
                    F.count(F.when(above & (F.col("n2") == F.col("mn")), 1)).alias("heads"), F.max("_at").alias("most")))
    table = write_table(out.select("n1", "n2", "mn"), path, compression="zstd")
    return table, {k: seen.get[k] or 0 for k in ("rows", "emitted", "heads", "most")}


def inner_nodes(g: DataFrame) -> DataFrame:
    """``(n2, m, deg)`` of every node that has both greater neighbours (``deg`` of them) and a lesser one (the least is ``m``)."""
    greater = g.where(F.col("n1") != F.col("n2")).groupBy("n2").agg(F.count(F.lit(1)).alias("deg"))
    heads = g.where((F.col("n2") == F.col("mn")) & (F.col("mn") < F.col("n1"))).select(F.col("n1").alias("_node"), F.col("mn").alias("m"))
    return greater.hint("shuffle_hash").join(heads, F.col("n2") == F.col("_node")).select("n2", "m", "deg")


def inner_summary(inner: DataFrame) -> tuple[int, int, int]:
    """``(rows of g that meet an inner node, most of them for one, degree above which a node is hot)`` in one action."""
    steps = [HOT_DEGREE << i for i in range(8)]
    row = inner.agg(F.sum("deg").alias("rows"), F.max("deg").alias("most"),
                    *[F.count(F.when(F.col("deg") > s, 1)).alias(f"hot{s}") for s in steps]).first()
    n_rows = int(row["rows"] or 0)
    fits = [s for s in steps if row[f"hot{s}"] <= MAX_HOT_KEYS]
    return n_rows, int(row["most"] or 0), fits[0] if fits else hot_threshold(n_rows, min_hot_degree=HOT_DEGREE, max_hot_keys=MAX_HOT_KEYS)


def grouped_output(g: DataFrame, inner: DataFrame, threshold: int, any_hot: bool) -> DataFrame:
    """The pairs that a round on ``g`` emits, with repeats."""
    near = (g.where(F.col("mn") < F.col("n1"))
            .select(F.when(F.col("n2") == F.col("mn"), F.col("n1")).otherwise(F.col("n2")).alias("n1"), F.col("mn").alias("n2")))
    rows = g.where(F.col("n1") != F.col("n2"))
    if any_hot:
        hot_rows, rows = split_hot(rows, inner, "n2", threshold, ["m"])
        near = near.union(hot_rows.where(F.col("m") != F.col("mn")).select("n1", F.col("m").alias("n2")))   # (n1, mn) is there already
        inner = inner.where(F.col("deg") <= threshold)
    far = rows.select("n1", "n2").join(inner.select("n2", "m").hint("shuffle_hash"), "n2")
    return near.union(far.select("n1", F.col("m").alias("n2")))
