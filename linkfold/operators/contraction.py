"""Connected components by edge contraction: the graph shrinks from round to round.

A round gives every node a representative, the node of its closed neighbourhood with the least hash (another hash each
round), replaces both ends of every edge by their representatives, drops the edges that became loops and the
repeated ones. An edge gives at most one edge, so the edges never grow; the nodes left are those that represent some, in
expectation at most three quarters of those before, so a graph of n nodes takes O(log n) rounds in
expectation, whatever its shape and the order of its ids (randomised contraction; Boegeholz, Brand, Todor 2018). A component that has
become a single node has no edge left and drops out.

The representatives of each round are kept as a table, and their sizes fall with the nodes. At the end they are joined from the
last round back to the first, which names each node's last representative, and the least id of a
component is its root.

No node is gathered: a hub's edges and the members of a giant component are matched map-side against the broadcast hot
keys, of which there are at most ``max_hot_keys`` (see ``keyed``).

Ids that are no whole numbers (texts) are numbered in their order first, so that the rounds move two numbers an edge; the numbers are
replaced by the ids again at the end. The order is kept, so the least number of a component stands for its least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from linkfold.operators.keyed import DEFAULT_MAX_HOT_KEYS, DEFAULT_MIN_HOT_DEGREE, hot_threshold, split_hot
from linkfold.operators.ordering import row_index
from linkfold.operators.pairs import canonical_pairs, mirror_canonical, mirror_union
from linkfold.storage import drop_path, new_scratch_path, scratch, write_table


def representatives(edges: DataFrame, seed: int) -> DataFrame:
    """``(node, rep, deg)`` of every node of the canonical loop-free ``edges(n1, n2)``: partial aggregation, so a hub is one row per task."""
    def ranked(node: str) -> Column:
        return F.struct(F.xxhash64(node, F.lit(seed)).alias("h"), F.col(node).alias("id"))

    best = (mirror_canonical(edges).groupBy(F.col("n1").alias("node"))
            .agg(F.min(ranked("n2")).alias("best"), F.count(F.lit(1)).alias("deg")))
    return best.select("node", F.least("best", ranked("node"))["id"].alias("rep"), "deg")


def replaced(df: DataFrame, col: str, names: DataFrame, threshold: int, any_hot: bool) -> DataFrame:
    """``df`` with ``col`` replaced by its name in ``names(<col>, _to, deg)``. Keys above ``threshold`` rows are
    matched map-side."""
    if not any_hot:
        joined = df.join(names.select(col, "_to"), col)
    else:
        hot_rows, cold_rows = split_hot(df, names, col, threshold, ["_to"])
        joined = hot_rows.unionByName(cold_rows.join(names.where(F.col("deg") <= threshold).select(col, "_to"), col))
    return joined.drop(col).withColumnRenamed("_to", col)


def contracted(edges: DataFrame, reps: DataFrame, threshold: int, any_hot: bool) -> DataFrame:
    """The edges between the representatives, each once, without loops."""
    out = edges
    for col in ("n1", "n2"):
        out = replaced(out, col, reps.select(F.col("node").alias(col), F.col("rep").alias("_to"), "deg"), threshold, any_hot)
    return canonical_pairs(out.where(F.col("n1") != F.col("n2")))


def named_by(members: DataFrame, names: DataFrame, n_members: int, **hot_opts) -> DataFrame:
    """``members(node, rep)`` with ``rep`` replaced by its name in ``names(node, rep)`` where it has one. As many members of one
    representative as there are rows do not meet in one task."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("deg"))
    known = sizes.join(names.select(F.col("node").alias("rep"), F.col("rep").alias("_name")), "rep", "left").select(
        "rep", F.coalesce("_name", "rep").alias("_to"), "deg")
    return replaced(members, "rep", known, hot_threshold(n_members, **hot_opts),
                    n_members > hot_threshold(n_members, **hot_opts)).select("node", "rep")


def numbered(pairs: DataFrame) -> DataFrame:
    """``(node, code, deg)`` of every id in ``pairs(n1, n2)``: its place in the order of the ids, and the rows of both sides that hold it."""
    nodes = mirror_union(pairs).groupBy(F.col("n1").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    return row_index(nodes, ["node"], "code")


def contract(pairs: DataFrame, max_rounds: int = 1000, hot_degree: int | None = None,
             min_hot_degree: int = DEFAULT_MIN_HOT_DEGREE, max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
             num_partitions: int | None = None, seed: int = 0) -> tuple[DataFrame, list[tuple[int, int, int]], str]:
    """``(pairs, trace, path)`` of the pair table ``pairs(n1, n2)``: the star forest ``(node, root)`` of the non-root nodes, at ``path``;
    ``trace`` has ``(round, nodes that were replaced, edges left)``."""
    spark = pairs.sparkSession
    opts = {"hot_degree": hot_degree, "min_hot_degree": min_hot_degree, "max_hot_keys": max_hot_keys}

    def table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
        path = new_scratch_path(spark, f"contract-{tag}")
        return write_table(df, path), path

    id_type, ids, coding = pairs.schema["n1"].dataType, None, []
    pairs = pairs.where(F.col("n1") != F.col("n2"))
    if not isinstance(id_type, IntegralType):
        pairs, pairs_at = table(pairs, "ids")
        seen, ids_at = Observation(), new_scratch_path(spark, "contract-codes")
        with scratch(spark):   # owns the sorted ids
            ids = write_table(numbered(pairs).observe(seen, F.sum("deg").alias("ends"), F.max("deg").alias("most")), ids_at)
        threshold = hot_threshold(seen.get["ends"] or 0, **opts)
        for col in ("n1", "n2"):
            pairs = replaced(pairs, col, ids.select(F.col("node").alias(col), F.col("code").alias("_to"), "deg"),
                             threshold, (seen.get["most"] or 0) > threshold)
        coding = [pairs_at, ids_at]
    edges, at = table(canonical_pairs(pairs), "r0")
    for path in coding[:1]:
        drop_path(spark, path)
    rounds: list[tuple[DataFrame, str, int]] = []
    trace: list[list[int]] = []
    for r in range(1, max_rounds + 1):
        seen = Observation()   # counted while the table is written
        reps, reps_at = table(representatives(edges, seed + r).observe(
            seen, F.count(F.lit(1)).alias("nodes"), F.sum("deg").alias("ends"), F.max("deg").alias("most"),
            F.count(F.when(F.col("rep") != F.col("node"), 1)).alias("moved")), f"reps{r}")
        nodes, ends, most = (seen.get[k] or 0 for k in ("nodes", "ends", "most"))
        if trace:
            trace[-1][2] = ends // 2   # every edge has two ends
        if not ends:
            drop_path(spark, reps_at)
            break
        threshold = hot_threshold(ends, **opts)
        out = contracted(edges, reps, threshold, most > threshold)
        nxt, nxt_at = table(out.repartition(num_partitions, "n1", "n2") if num_partitions else out, f"r{r}")
        drop_path(spark, at)
        edges, at = nxt, nxt_at
        rounds.append((reps.select("node", "rep"), reps_at, nodes))
        trace.append([r, seen.get["moved"], -1])
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds; raise max_rounds")
    if not rounds:   # no edge at all: the empty table is the result
        for path in coding[1:]:
            drop_path(spark, path)
        return edges.select(*[edges[c] if ids is None else F.lit(None).cast(id_type).alias(c) for c in ("n1", "n2")]), [(1, 0, 0)], at
    drop_path(spark, at)

    names, names_at, n = rounds.pop()
    while rounds:   # from the last round, which has the fewest nodes, to the first
        members, members_at, n = rounds.pop()
        joined, joined_at = table(named_by(members, names, n, **opts), "names")
        for old in (members_at, names_at):
            drop_path(spark, old)
        names, names_at = joined, joined_at
    # one aggregation gives the least id of each component, and its members take it as their root
    roots = names.groupBy("rep").agg(F.min("node").alias("_to"), F.count(F.lit(1)).alias("deg"))
    threshold = hot_threshold(n, **opts)
    if ids is not None:   # the ids of the roots and of their members for the numbers: one join each
        roots = roots.join(ids.select(F.col("code").alias("_to"), F.col("node").alias("_id")), "_to").select("rep", F.col("_id").alias("_to"), "deg")
        names = names.join(ids.select(F.col("code").alias("node"), F.col("node").alias("_id")), "node").select(F.col("_id").alias("node"), "rep")
    rooted = replaced(names, "rep", roots, threshold, n > threshold).where(F.col("node") != F.col("rep"))
    stars, path = table(rooted.select(F.col("node").alias("n1"), F.col("rep").alias("n2")), "stars")
    for old in [names_at, *coding[1:]]:
        drop_path(spark, old)
    return stars, [tuple(t) for t in trace], path
