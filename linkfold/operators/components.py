"""The fixpoint loop: rounds until no new pair appears.

The input is first written once as canonical undirected edges. Each round is two jobs: one aggregate action over the per-key stats (``new_pairs``, the
size of the mirrored set, which sizes the hot-key threshold and gives the previous
round's pair count, and the largest degree), and the round itself, written as a Parquet
table in the checkpoint folder. The next round reads that table, so
the plan never grows with the round number, and the previous table is deleted.

At the fixpoint the pair table is a star forest: one row ``(node, root)`` per non-root
node, the root being the smallest id of the component. Once ``new_pairs`` is 0 in a
round after the first, that round would reproduce its input, so the loop records the
round and stops without running it.

A run with a name (``resume``) writes after every round where its table is and the trace so far. Started again under
the same name, also by another driver, it goes on after the last finished round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.operators import grouped
from linkfold.operators.contraction import contract
from linkfold.operators.keyed import DEFAULT_MAX_HOT_KEYS, DEFAULT_MIN_HOT_DEGREE, hot_threshold
from linkfold.operators.pairs import as_pairs, canonical_pairs, mirror_canonical
from linkfold.operators.rounds import mirror, round_output, round_stats, stats_summary
from linkfold.storage import RunManifest, drop_path, new_scratch_path, scratch, write_table


@dataclass
class ComponentsResult:
    """``pairs``: the converged ``(n1, n2)`` table; ``trace``: ``(round, new_pairs, pairs)``;
    ``path``: where that table lives in the checkpoint folder."""
    pairs: DataFrame
    trace: list[tuple[int, int, int]] = field(default_factory=list)
    path: str | None = None
    states: DataFrame | None = None      # (round, n1, n2) of every round, if they were asked for
    state_paths: list[str] = field(default_factory=list)
    run: RunManifest | None = None       # of a run with a name

    def release(self) -> None:
        """Delete the result tables from the checkpoint folder (after their results are
        written elsewhere); ``pairs``, ``states`` and ``membership()`` cannot be read afterwards."""
        for path in {*self.state_paths, *([self.path] if self.path else [])}:
            drop_path(self.pairs.sparkSession, path)
        if self.run:
            self.run.drop()
        self.path, self.state_paths, self.run = None, [], None

    @property
    def rounds(self) -> int:
        return len(self.trace)

    def membership(self, include_roots: bool = False, vertices: DataFrame | None = None,
                   vertex_col: str = "node") -> DataFrame:
        """``(node, component)``; roots have a row of their own only if asked for.

        ``vertices`` (with ``include_roots``) adds every listed node that is in no pair
        as its own one-node component.
        """
        m = self.pairs.select(F.col("n1").alias("node"), F.col("n2").alias("component"))
        if include_roots:
            roots = m.select(F.col("component").alias("node"), "component").distinct()
            m = m.union(roots)
            if vertices is not None:
                v = vertices.select(F.col(vertex_col).alias("node")).distinct()
                lone = v.join(m.select("node"), "node", "left_anti")
                m = m.union(lone.select("node", F.col("node").alias("component")))
        return m

    def trace_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.trace, "round int, new_pairs long, pairs long")


def iterate(g: DataFrame, strategy: str = "join", max_rounds: int = 1000,
            rounds: int | None = None, hot_degree: int | None = None,
            min_hot_degree: int = DEFAULT_MIN_HOT_DEGREE,
            max_hot_keys: int = DEFAULT_MAX_HOT_KEYS, num_partitions: int | None = None,
            keep_states: bool = False, resume: str | None = None) -> ComponentsResult:
    """Run rounds on pair table ``g(n1, n2)``.

    ``rounds=None`` runs to the fixpoint and raises if ``max_rounds`` is not enough
    (a truncated answer would be wrong). ``rounds=n`` runs exactly ``n`` rounds (the
    step-by-step view) and returns whatever state that is; ``keep_states`` keeps the pairs
    after every round in ``states``. ``num_partitions`` is the partition count of the round
    tables (else the session's). If a round fails, the tables written so far are deleted, but for a
    run with a name: ``resume`` names it, and a later call with that name (and the same input, which is not read again) goes on
    after its last finished round. ``release`` of the result ends the named run.
    """
    if resume and keep_states:
        raise ValueError("a run that keeps every state cannot be resumed")
    if strategy == "grouped" and (resume or keep_states or rounds is not None):
        raise ValueError("grouped rounds run to the fixpoint, without a name and without states")
    with scratch(g.sparkSession, keep=True):
        if strategy == "grouped":
            return _iterate_grouped(g, max_rounds, hot_degree, min_hot_degree, max_hot_keys, num_partitions)
        return _iterate(g, strategy, max_rounds, rounds, hot_degree, min_hot_degree, max_hot_keys, num_partitions, keep_states,
                        RunManifest(g.sparkSession, resume) if resume else None)


def _iterate_grouped(g: DataFrame, max_rounds: int, hot_degree: int | None, min_hot_degree: int, max_hot_keys: int,
                     num_partitions: int | None) -> ComponentsResult:
    """The same rounds over pairs that stay grouped by their greater id (``grouped``)."""
    spark = g.sparkSession
    opts = {"hot_degree": hot_degree, "min_hot_degree": min_hot_degree, "max_hot_keys": max_hot_keys}
    trace: list[list[int]] = []
    path = new_scratch_path(spark, "cc-g0")
    g, counts = grouped.group_pairs(g.select(F.greatest("n1", "n2").alias("n1"), F.least("n1", "n2").alias("n2")), path, num_partitions=num_partitions)
    for r in range(1, max_rounds + 1):
        if trace:
            trace[-1][2] = counts["rows"]
        if counts["most"] > hot_threshold(2 * counts["rows"], **opts):
            # too many lesser neighbours of one node for a task: the rounds that spread them go on from here
            return _iterate(g.select("n1", "n2"), "join", max_rounds, None, hot_degree, min_hot_degree, max_hot_keys, num_partitions,
                            False, None, {"step": r - 1, "path": path, "trace": trace})
        inner = grouped.inner_nodes(g).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            far, most, threshold = grouped.inner_summary(inner)
            new_pairs = counts["emitted"] - counts["heads"] + far
            trace.append([r, new_pairs, counts["rows"]])
            if new_pairs == 0 and r > 1:
                return _result(g.select("n1", "n2"), trace, path, [], None)
            old, path = path, new_scratch_path(spark, f"cc-g{r}")
            g, counts = grouped.group_pairs(grouped.grouped_output(g, inner, threshold, most > threshold), path,
                                            counts["emitted"] + far, num_partitions)
        finally:
            inner.unpersist()
        drop_path(spark, old)
        if new_pairs == 0:
            trace[-1][2] = counts["rows"]
            return _result(g.select("n1", "n2"), trace, path, [], None)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds; raise max_rounds")


def _iterate(g: DataFrame, strategy: str, max_rounds: int, rounds: int | None, hot_degree: int | None, min_hot_degree: int,
             max_hot_keys: int, num_partitions: int | None, keep_states: bool, run: RunManifest | None,
             done: dict | None = None) -> ComponentsResult:
    spark = g.sparkSession
    kept: list[tuple[int, str, DataFrame]] = []
    trace: list[list[int]] = []
    new_path = run.table_path if run else lambda tag: new_scratch_path(spark, tag)
    done = run.last() if run else done
    if done:
        prev_path, trace = done["path"], done["trace"]
        g = spark.read.schema(canonical_pairs(g).schema).parquet(prev_path)   # a grouped table's third column is left out
    else:
        # round 0: the input, de-duplicated as undirected edges and written once, so the
        # source is scanned once and every round's mirrored set is a narrow union of scans
        prev_path = new_path("cc-r0")
        g = write_table(canonical_pairs(g), prev_path)
        if run:
            run.write(0, {"path": prev_path, "trace": []})
    limit = rounds if rounds is not None else max_rounds
    for r in range((done["step"] if done else 0) + 1, limit + 1):
        first = r == 1
        s = mirror_canonical(g) if first else mirror(g, False)
        stats = round_stats(s).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            new_pairs, rows, max_deg = stats_summary(stats)
            if not first:
                # the mirrored set of round r is exactly twice the pairs of round r - 1
                trace[-1][2] = rows // 2
            if new_pairs == 0 and not first:
                trace.append([r, 0, rows // 2])
                if keep_states:   # this and all later rounds reproduce their input
                    kept += [(k, prev_path, g) for k in range(r, (rounds or r) + 1)]
                return _result(g, trace, prev_path, kept, run)
            threshold = hot_threshold(rows, hot_degree=hot_degree,
                                      min_hot_degree=min_hot_degree, max_hot_keys=max_hot_keys)
            path = new_path(f"cc-r{r}")
            nxt = write_table(round_output(s, stats, strategy, threshold, max_degree=max_deg,
                                           num_partitions=num_partitions), path)
        finally:
            stats.unpersist()
        if keep_states:
            kept.append((r, path, nxt))
        trace.append([r, new_pairs, -1])
        if run:
            run.write(r, {"path": path, "trace": trace})
        if not keep_states or r == 1:
            drop_path(spark, prev_path)
        prev_path, g = path, nxt
        if new_pairs == 0 and rounds is None:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds; raise max_rounds")
    if trace:
        trace[-1][2] = g.count()   # only the last round's size is not known from a later round
    return _result(g, trace, prev_path, kept, run)


def _result(g: DataFrame, trace: list, path: str, kept: list, run: RunManifest | None) -> ComponentsResult:
    states = None
    for r, _, table in kept:
        part = table.select(F.lit(r).alias("round"), "n1", "n2")
        states = part if states is None else states.unionByName(part)
    return ComponentsResult(g, [tuple(t) for t in trace], path, states, [p for _, p, _ in kept], run)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         strategy: str = "join", **opts) -> ComponentsResult:
    """Connected components of the undirected graph given by ``edges(src, dst)``.

    Rows with a null id are dropped. A node whose only edge is a self-loop is in no
    output row (it has no partner), as in the analysed algorithm.

    ``strategy`` is one of the four of a round (``rounds``), or ``grouped``: the same rounds and trace with fewer rows moved
    (``grouped``), or ``contract``: the edges shrink from round to round instead of being
    rewritten into stars (``contraction``). The membership is the same; its trace counts replaced nodes and edges left.
    """
    if strategy == "contract":
        g = as_pairs(edges, src, dst)
        with scratch(g.sparkSession, keep=True):
            stars, trace, path = contract(g, **opts)
        return ComponentsResult(stars, trace, path)
    return iterate(as_pairs(edges, src, dst), strategy=strategy, **opts)
