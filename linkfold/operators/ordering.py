"""Order-dependent operators that stay distributed.

All of them start from ``ordered``: the rows range-partitioned and sorted on the whole sort key, so a group that holds a
third of all rows spans many partitions. What a row needs from the partitions before its own comes from tables of one
row per partition, which one ordered window folds up:

* ``running_totals``: a segmented prefix sum. Sums run inside (range partition, group); only a partition's first group
  can have begun earlier, and what the partitions before hold of it is one carry row per partition, however many
  partitions the group spans. ``rank_in_group``, ``chunked_lists`` and ``sorted_sets`` are built on it.
* ``previous_row``: the row before in the whole order; ``previous_in_group`` is ``lag(order) over (partition by group
  order by order)`` without a window partition per group.
* ``row_index``: contiguous 0-based ids in a sort order (what ``zipWithIndex`` gives an RDD): position in the partition plus
  the partition's offset.
* ``partition_profile`` and ``secondary_sort``: the partition layout tools of the analysed
  code (key partitioner, composite-key partitioner + sort), the latter range-partitioned so a hub
  key spans partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.storage import new_scratch_path, write_table

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id: partition id << 33 | record number
_BEFORE = Window.unboundedPreceding, -1


def ordered(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted on ``order_cols``, each row tagged with
    ``_mid`` (partition id << 33 | position in the partition) and ``_pid`` (partition id), written once to the
    checkpoint folder so the tags are stable however often the result is recomputed
    (``monotonically_increasing_id`` is not deterministic across re-executions with a
    different partitioning)."""
    tagged = secondary_sort(df, order_cols, num_partitions).withColumn(
        "_mid", F.monotonically_increasing_id())
    table = write_table(tagged, new_scratch_path(df.sparkSession, "ranged"))
    return table.withColumn("_pid", F.shiftright("_mid", 33))


def previous_row(t: DataFrame, cols: list[str], out_col: str = "_prev") -> DataFrame:
    """``ordered`` rows with ``out_col``: a struct of ``cols`` of the row before in the whole order, null for the first row.

    ``lag`` runs over a window per range partition; a partition's first row takes the last row of
    the previous non-empty partition from a table of one row per partition.
    """
    row = F.struct(*cols)
    local = t.withColumn("_lag", F.lag(row).over(Window.partitionBy("_pid").orderBy("_mid")))
    lasts = t.groupBy("_pid").agg(F.max_by(row, "_mid").alias("_last"))
    before = lasts.select(F.col("_pid").alias("_q"), F.lag("_last").over(Window.orderBy("_pid")).alias("_before"))
    return (local.join(F.broadcast(before), F.col("_pid") == F.col("_q"))
            .withColumn(out_col, F.coalesce("_lag", "_before")).drop("_q", "_lag", "_before"))


def partition_carries(t: DataFrame, totals: dict[str, Column], group_cols: list[str]) -> DataFrame:
    """``(_q, _first, <out>...)``, one row per non-empty range partition of ``ordered`` rows: its first group and the sums
    of that group over all partitions before.

    The partitions form runs: a run ends where a partition is not wholly of the group it began in. Inside a run the
    sums of the last group add up, so one window over the table gives every carry.
    """
    group = F.struct(*group_cols) if group_cols else F.struct(F.lit(1).alias("all"))
    keyed = t.select("_pid", "_mid", group.alias("_group"), *[v.alias(f"_v_{k}") for k, v in totals.items()])
    ends = keyed.groupBy("_pid").agg(F.min_by("_group", "_mid").alias("_first"), F.max_by("_group", "_mid").alias("_last"))
    tails = (keyed.join(F.broadcast(ends.select(F.col("_pid").alias("_p"), "_last")),
                        (F.col("_pid") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_last")))
             .groupBy(F.col("_p").alias("_tail_of")).agg(*[F.sum(f"_v_{k}").alias(f"_v_{k}") for k in totals]))
    rows = ends.join(F.broadcast(tails), F.col("_pid") == F.col("_tail_of"))
    by_pid = Window.orderBy("_pid")
    rows = rows.withColumn("_left", F.lag("_last").over(by_pid))
    begins = ~(F.col("_first").eqNullSafe(F.col("_last")) & F.col("_left").eqNullSafe(F.col("_first")))
    rows = rows.withColumn("_run", F.sum(begins.cast("int")).over(by_pid))
    rows = rows.withColumns({f"_v_{k}": F.sum(f"_v_{k}").over(Window.partitionBy("_run").orderBy("_pid")) for k in totals})
    held = {k: F.when(F.col("_left").eqNullSafe(F.col("_first")), F.lag(f"_v_{k}").over(by_pid)) for k in totals}
    return rows.select(F.col("_pid").alias("_q"), "_first", *[F.coalesce(held[k], F.lit(0)).alias(f"_c_{k}") for k in totals])


def running_totals(t: DataFrame, totals: dict[str, Column], group_cols: list[str] = ()) -> DataFrame:
    """``ordered`` rows with, for each ``out: value`` of ``totals``, the sum of the value over the earlier rows of the same group.

    ``t`` must be ordered on ``group_cols`` before anything else; without group columns the whole table is one group.
    """
    group_cols = list(group_cols)
    group = F.struct(*group_cols) if group_cols else F.struct(F.lit(1).alias("all"))
    w = Window.partitionBy("_pid", *group_cols).orderBy("_mid").rowsBetween(*_BEFORE)
    local = t.withColumns({f"_l_{k}": F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in totals.items()})
    carries = partition_carries(t, totals, group_cols)   # as many rows as range partitions
    joined = local.join(F.broadcast(carries), F.col("_pid") == F.col("_q"))
    begun = group.eqNullSafe(F.col("_first"))
    return (joined.withColumns({k: F.col(f"_l_{k}") + F.when(begun, F.col(f"_c_{k}")).otherwise(0) for k in totals})
            .drop("_q", "_first", *[f"_l_{k}" for k in totals], *[f"_c_{k}" for k in totals]))


def row_index(df: DataFrame, order_cols: list[str], out_col: str = "idx",
              num_partitions: int | None = None, position: list[str] | None = None) -> DataFrame:
    """Append ``out_col``: the row's 0-based position in ``order_cols`` order.

    What is sorted is written to the checkpoint folder once, so the ids are stable
    however often the result is recomputed. Ties in ``order_cols`` are numbered in an
    arbitrary order. ``position`` names columns that tell a row from every other and are the same each time ``df`` is
    computed (a key; for a Parquet scan ``_metadata.file_path`` and ``_metadata.row_index``): then only the order columns and
    the position are sorted and stored, and the numbers are joined to the rows by position. Without it, and with columns
    beside the order columns, whole rows are stored.
    """
    if position is None or set(df.columns) <= set(order_cols):
        return _indexed(df, order_cols, out_col, num_partitions).select(*df.columns, out_col)
    keys = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                     *[F.col(c).alias(f"_k{i}") for i, c in enumerate(position)])
    numbers = _indexed(keys, [f"_o{i}" for i in range(len(order_cols))], out_col, num_partitions)
    same = [F.col(f"_j{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(position))]
    rows = df.select(*df.columns, *[F.col(c).alias(f"_j{i}") for i, c in enumerate(position)])
    return rows.join(numbers, same).select(*df.columns, out_col)


def _indexed(df: DataFrame, order_cols: list[str], out_col: str, num_partitions: int | None) -> DataFrame:
    table = ordered(df, order_cols, num_partitions)
    # one row per partition: bounded by the partition count, never by the data
    counts = table.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("_pid").alias("_q"), F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"))
    return (table.join(F.broadcast(offsets), F.col("_pid") == F.col("_q"))
            .withColumn(out_col, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))


def previous_in_group(df: DataFrame, group_col: str, order_col: str,
                      out_col: str = "prev", num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``out_col`` = the previous ``order_col`` value inside the same group
    (null for the first row of a group). ``(group_col, order_col)`` should be unique."""
    t = previous_row(ordered(df.select(group_col, order_col), [group_col, order_col], num_partitions), [group_col, order_col])
    same = F.col("_prev").isNotNull() & F.col(group_col).eqNullSafe(F.col("_prev")[group_col])
    return t.select(group_col, order_col, F.when(same, F.col("_prev")[order_col]).alias(out_col))


def rank_in_group(df: DataFrame, group_col: str, order_col: str, out_col: str = "rnk",
                  num_partitions: int | None = None) -> DataFrame:
    """``(group_col, order_col, out_col)``: the row's 0-based position in its group."""
    t = ordered(df.select(group_col, order_col), [group_col, order_col], num_partitions)
    return running_totals(t, {out_col: F.lit(1)}, [group_col]).select(group_col, order_col, F.col(out_col).cast("long").alias(out_col))


def chunked_lists(df: DataFrame, group_col: str, value_col: str, out_col: str = "values",
                  size: int = 1024) -> DataFrame:
    """``(group_col, chunk, out_col array)``: each group's values in order, ``size`` to a row, for any
    type that sorts. ``chunk`` counts a group's rows from 0, so a group of up to ``size`` values
    is one whole list. Repeated values stay; de-duplicate first for a set."""
    ranked = rank_in_group(df, group_col, value_col, "_rank")
    return (ranked.groupBy(group_col, F.expr(f"_rank div {int(size)}").alias("chunk"))
            .agg(F.sort_array(F.collect_list(value_col)).alias(out_col)))


def sorted_sets(df: DataFrame, group_col: str, value_col: str, out_col: str = "values", size: int = 1024,
                num_partitions: int | None = None) -> DataFrame:
    """``(group_col, chunk, out_col array)``: each group's different values in order, ``size`` to a row.

    One sort does both jobs: a value that equals the row before in the order is a repeat, and the number of new values
    before a row is its rank in the set. Rows are never shuffled by group, so repeats of one value may be a third of all rows.
    """
    t = previous_row(ordered(df.select(group_col, value_col), [group_col, value_col], num_partitions), [group_col, value_col])
    same = F.col("_prev").isNotNull() & F.struct(group_col, value_col).eqNullSafe(F.col("_prev"))
    first = write_table(t.where(~same).select(group_col, value_col, "_mid"), new_scratch_path(df.sparkSession, "sets"))
    ranked = running_totals(first.withColumn("_pid", F.shiftright("_mid", 33)), {"_rank": F.lit(1)}, [group_col])
    return (ranked.groupBy(group_col, F.expr(f"_rank div {int(size)}").alias("chunk"))
            .agg(F.sort_array(F.collect_list(value_col)).alias(out_col)))


def partition_profile(df: DataFrame, key: str, n: int) -> DataFrame:
    """``(partition, n_rows)``: how many rows the partitioner ``pmod(key, n)`` gives each partition."""
    return (df.groupBy(F.pmod(F.col(key), F.lit(n)).cast("int").alias("partition"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def secondary_sort(df: DataFrame, order_cols: list[str],
                   num_partitions: int | None = None) -> DataFrame:
    """The composite-key shuffle sort: rows of one key together and sorted by the rest
    of ``order_cols`` inside each partition.

    The analysed code hash-partitions on the first key part alone, which puts every row
    of a hub key into one task. Range partitioning on the whole composite key keeps each
    key's rows contiguous and sorted but lets a key that is a large share of all rows
    span several partitions, so consumers take a group's head from the group statistics
    (``attach_group_min``) rather than from the first row of a partition.
    """
    parts = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
             else df.repartitionByRange(*order_cols))
    return parts.sortWithinPartitions(*order_cols)
