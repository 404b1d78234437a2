import os

import pytest
from pyspark.sql import functions as F

from graphs import EXAMPLE, REPEATED, TWO_GRAPHS, chain, hub, membership_of, random_graph
from linkfold.operators import grouped
from linkfold.operators.components import connected_components, iterate
from linkfold.operators.keyed import hot_threshold
from linkfold.operators.pairs import as_pairs
from linkfold.operators.reports import component_sizes
from linkfold.operators.rounds import LIST_SIZE, STRATEGIES, _bounded_sets, cc_round, mirror, round_stats
from linkfold.storage import checkpoint_root


def edges_df(spark, rows, id_type="long"):
    return spark.createDataFrame(rows, f"src {id_type}, dst {id_type}")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def trace2(res):
    return [(np, p) for _, np, p in res.trace]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_example_lexical(spark, strategy):
    res = connected_components(edges_df(spark, EXAMPLE, "string"), strategy=strategy)
    assert trace2(res) == [(4, 10), (9, 8), (4, 6), (0, 6)]
    assert rows(res.pairs, "n1", "n2") == [("B", "A"), ("C", "A"), ("D", "A"), ("E", "A"),
                                           ("G", "F"), ("H", "F")]


def test_example_round_states(spark):
    g = as_pairs(edges_df(spark, EXAMPLE, "string"))
    r1 = iterate(g, rounds=1).pairs
    assert ["".join(p) for p in rows(r1, "n1", "n2")] == \
        "BA CA CB DA DB EB ED GF HF HG".split()
    r2 = iterate(g, rounds=2).pairs
    assert ["".join(p) for p in rows(r2, "n1", "n2")] == "BA CA DA DB EA EB GF HF".split()


def test_two_graphs_numeric_and_lexical(spark):
    num = connected_components(edges_df(spark, TWO_GRAPHS))
    assert trace2(num) == [(19, 22), (25, 16), (10, 11), (0, 11)]
    sizes = dict(rows(component_sizes(num.membership()), "component", "n_nodes"))
    assert sizes == {1: 8, 9: 5}
    lex = connected_components(edges_df(spark, [(str(a), str(b)) for a, b in TWO_GRAPHS], "string"))
    assert trace2(lex) == [(17, 19), (19, 16), (10, 11), (0, 11)]
    assert dict(rows(component_sizes(lex.membership()), "component", "n_nodes")) == {"1": 8, "10": 5}


def plain_rounds(edges):
    """The trace by the definition, on Python sets."""
    g, trace = {(a, b) for a, b in edges}, []
    while not trace or trace[-1][0]:
        s = g | {(b, a) for a, b in g}
        out, new = set(), 0
        for key in {a for a, _ in s}:
            values = {b for a, b in s if a == key}
            least = min(values)
            if least < key:
                out |= {(key, least)} | {(v, least) for v in values if v != least}
                new += len(values) - 1
        g = out
        trace.append((new, len(g)))
    return trace


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_repeated_edges(spark, strategy):
    res = connected_components(edges_df(spark, REPEATED, "string"), strategy=strategy)
    assert trace2(res) == plain_rounds(REPEATED)
    assert dict(rows(component_sizes(res.membership()), "component", "n_nodes")) == {"a": 4, "x": 3}


def test_states_of_every_round(spark):
    g = as_pairs(edges_df(spark, TWO_GRAPHS))
    res = iterate(g, rounds=3, keep_states=True)
    for r in (1, 2, 3):
        want = rows(iterate(g, rounds=r).pairs, "n1", "n2")
        assert rows(res.states.where(F.col("round") == r), "n1", "n2") == want
    res.release()
    assert not any(os.path.exists(p.replace("file:", "")) for p in res.state_paths)


def test_partition_count_of_the_round_tables(spark):
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        res = iterate(as_pairs(edges_df(spark, random_graph(400, 900, 3))), rounds=1, num_partitions=7)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
    files = {f for f in res.pairs.inputFiles()}
    assert len(files) == 7
    full = connected_components(edges_df(spark, TWO_GRAPHS), num_partitions=3)
    assert rows(full.membership(), "node", "component") == membership_of(TWO_GRAPHS)


def test_failed_run_leaves_no_table(spark):
    root = checkpoint_root(spark).replace("file:", "")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    with pytest.raises(RuntimeError):
        connected_components(edges_df(spark, chain(50)), max_rounds=2)
    assert set(os.listdir(root)) == before


def test_sets_stay_bounded_whatever_the_degree(spark):
    e = as_pairs(edges_df(spark, hub(30_000)))
    s = mirror(e, True)
    stats = round_stats(s)
    sizes = _bounded_sets(s, stats).agg(F.max(F.size("nbrs"))).first()[0]
    assert sizes <= 2 * LIST_SIZE


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs_against_union_find(spark, seed):
    e = random_graph(120, 110, seed)
    res = connected_components(edges_df(spark, e))
    assert rows(res.membership(), "node", "component") == membership_of(e)


def test_strategies_agree_round_by_round(spark):
    e = random_graph(80, 90, 11)
    g = as_pairs(edges_df(spark, e))
    outs = {s: rows(cc_round(g, s), "n1", "n2") for s in STRATEGIES}
    assert len({tuple(v) for v in outs.values()}) == 1
    finals = {s: trace2(connected_components(edges_df(spark, e), strategy=s)) for s in STRATEGIES}
    assert len({tuple(v) for v in finals.values()}) == 1


def test_long_chain_keeps_plan_flat(spark):
    e = chain(300)
    res = connected_components(edges_df(spark, e))
    assert rows(res.membership(), "node", "component") == membership_of(e)
    # the result is a scan of the last round table, not a plan grown over the rounds
    plan = res.pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_hot_keys_take_the_broadcast_path(spark, strategy):
    e = hub(60) + random_graph(40, 30, 5)
    expected = membership_of(e)
    res = connected_components(edges_df(spark, e), strategy=strategy,
                               min_hot_degree=8, max_hot_keys=1000)
    assert rows(res.membership(), "node", "component") == expected
    plain = connected_components(edges_df(spark, e), strategy=strategy)
    assert res.trace == plain.trace


def test_hot_round_plan_broadcasts_and_does_not_shuffle_hot_rows(spark):
    g = as_pairs(edges_df(spark, hub(60)))
    out = cc_round(g, "join", min_hot_degree=8, max_hot_keys=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_star_hub_hot_under_default_thresholds(spark):
    """A hub above the default hot degree (100k), not the smallest id: round one's
    whole output comes from the hub's row group, matched against the broadcast stats."""
    n, hub_id = 200_000, 10**9
    e = spark.range(n).select(F.lit(hub_id).alias("src"), F.col("id").alias("dst"))
    plan = cc_round(as_pairs(e), "join")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    res = connected_components(e)
    assert [t[1:] for t in res.trace] == [(n - 1, n), (0, n)]
    sizes = component_sizes(res.membership()).collect()
    assert [(r["component"], r["n_nodes"]) for r in sizes] == [(0, n + 1)]


def _live_plan(plan: str) -> str:
    """The executed plan without the subtrees under cached relations (computed once, by
    the round's stats action, not by the round itself)."""
    keep, skip = [], None
    for line in plan.splitlines():
        lvl = len(line) - len(line.lstrip(" :+-|"))
        if skip is not None and lvl > skip:
            continue
        skip = None
        keep.append(line)
        if "InMemoryRelation" in line:
            skip = lvl
    return "\n".join(keep)


@pytest.mark.parametrize("hot", [False, True])
def test_round_plan_shape_at_scale_settings(spark, tmp_path, hot):
    """With broadcasts off for data-sized sides (as on big inputs): one scan, the pair
    shuffle for the join and the distinct shuffle; hot keys add two bounded broadcasts
    and a second scan, and their rows are joined map-side."""
    from linkfold.operators.rounds import mirror, round_output, round_stats, stats_summary
    e = hub(60) + random_graph(40, 30, 5)
    rows_ = sorted({(min(a, b), max(a, b)) for a, b in e if a != b})
    spark.createDataFrame(rows_, "n1 long, n2 long").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = mirror(g, False)
        stats = round_stats(s).persist()
        _, n, mx = stats_summary(stats)
        opts = {"min_hot_degree": 8, "max_hot_keys": 1000} if hot else {}
        out = round_output(s, stats, "join", hot_threshold(n, **opts), max_degree=mx)
        plan = _live_plan(out._jdf.queryExecution().executedPlan().toString())
        stats.unpersist()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("FileScan parquet") == (2 if hot else 1)
    assert plan.count("BroadcastExchange") == (2 if hot else 0)
    assert ("BroadcastHashJoin" in plan) == hot and plan.count("SortMergeJoin") == 1


def labelled(edges):
    return [(f"n{a:03d}", f"n{b:03d}") for a, b in edges]


@pytest.mark.parametrize("edges, id_type", [
    (EXAMPLE, "string"), (REPEATED, "string"), (TWO_GRAPHS, "long"), (chain(40), "int"), (random_graph(120, 110, 1), "long"),
    (random_graph(60, 240, 2) + [(7, 7), (900, 900), (3, 3)], "long"), (labelled(hub(60) + random_graph(40, 30, 5)), "string")])
@pytest.mark.parametrize("hot_degree", [1, 1_000])
def test_grouped_rounds_have_the_same_trace_and_pairs(spark, monkeypatch, edges, id_type, hot_degree):
    monkeypatch.setattr(grouped, "HOT_DEGREE", hot_degree)
    want = connected_components(edges_df(spark, edges, id_type))
    res = connected_components(edges_df(spark, edges, id_type), strategy="grouped")
    assert res.trace == want.trace and trace2(res) == plain_rounds(edges)
    assert rows(res.pairs, "n1", "n2") == rows(want.pairs, "n1", "n2")
    res.release()
    assert res.path is None


def test_every_grouped_round_is_a_round(spark, tmp_path):
    """Round for round the pairs of ``cc_round``, with the counts that the loop takes from the write."""
    edges = random_graph(80, 160, 11) + [(5, 5)]
    plain = as_pairs(edges_df(spark, edges))
    g, counts = grouped.group_pairs(plain.select(F.greatest("n1", "n2").alias("n1"), F.least("n1", "n2").alias("n2")), str(tmp_path / "g0"))
    for r in range(1, 4):
        want = cc_round(plain, first_round=r == 1)
        new = cc_round(plain, first_round=r == 1, dedup=False).count() - counts["heads"]
        inner = grouped.inner_nodes(g)
        far, most, _ = grouped.inner_summary(inner)
        assert counts["emitted"] - counts["heads"] + far == new
        nxt, counts = grouped.group_pairs(grouped.grouped_output(g, inner, 3, most > 3), str(tmp_path / f"g{r}"), num_partitions=3)
        assert rows(nxt, "n1", "n2") == rows(want, "n1", "n2") and counts["rows"] == want.count()
        least = {}
        for a, b, mn in rows(nxt, "n1", "n2", "mn"):
            assert mn <= b and least.setdefault(a, mn) == mn
        g, plain = nxt, spark.createDataFrame(want.collect(), want.schema)


def test_a_grouped_round_moves_a_pair_once_for_its_join(spark, tmp_path):
    """With broadcasts off for data-sized sides no mirrored set is made, and besides the rows that look up the minimum of ``n2`` only node tables are shuffled."""
    g, _ = grouped.group_pairs(spark.createDataFrame([(b, a) for a, b in chain(40)], "n1 long, n2 long"), str(tmp_path / "g"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        inner = grouped.inner_nodes(g).persist()
        plan = _live_plan(grouped.grouped_output(g, inner, 1_000, False)._jdf.queryExecution().executedPlan().toString())
        inner.unpersist()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ShuffledHashJoin") == 1
    assert "Generate" not in plan and "Sort" not in plan


def test_a_hot_degree_grows_until_its_keys_fit(spark, monkeypatch):
    inner = spark.createDataFrame([(i, 0, 300 if i < 20 else 2000) for i in range(30)], "n2 long, m long, deg long")
    assert grouped.inner_summary(inner) == (26_000, 2000, 256)
    monkeypatch.setattr(grouped, "MAX_HOT_KEYS", 10)
    assert grouped.inner_summary(inner) == (26_000, 2000, 512)
    monkeypatch.setattr(grouped, "HOT_DEGREE", 1)
    monkeypatch.setattr(grouped, "MAX_HOT_KEYS", 5)
    assert grouped.inner_summary(inner)[2] == 5200


def test_grouped_rounds_leave_a_hub_of_lesser_neighbours_to_the_spread_rounds(spark):
    e = [(1000, x) for x in range(1, 40)] + random_graph(40, 30, 5)
    want = connected_components(edges_df(spark, e))
    root = checkpoint_root(spark).replace("file:", "")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    res = connected_components(edges_df(spark, e), strategy="grouped", min_hot_degree=8, max_hot_keys=1000)
    assert res.trace == want.trace and rows(res.membership(), "node", "component") == membership_of(e)
    res.release()
    want.release()
    assert set(os.listdir(root)) <= before
    with pytest.raises(RuntimeError):
        connected_components(edges_df(spark, chain(50)), strategy="grouped", max_rounds=2)
    with pytest.raises(ValueError):
        iterate(as_pairs(edges_df(spark, e)), strategy="grouped", rounds=2)
    empty = connected_components(edges_df(spark, [(5, 5), (None, 4)]), strategy="grouped")
    assert empty.pairs.count() == 0 and empty.trace == [(1, 0, 0)]


@pytest.mark.parametrize("opts", [{}, {"min_hot_degree": 4, "max_hot_keys": 1000}])
@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_against_union_find(spark, seed, opts):
    e = random_graph(120, 110, seed) + hub(60)
    res = connected_components(edges_df(spark, e), strategy="contract", **opts)
    assert rows(res.membership(), "node", "component") == membership_of(e)
    n_edges = len({(min(a, b), max(a, b)) for a, b in e if a != b})
    assert all(p <= n_edges for _, _, p in res.trace) and res.trace[-1][2] == 0
    left = [p for _, _, p in res.trace]
    assert left == sorted(left, reverse=True)
    res.release()
    assert res.path is None


def test_contraction_of_the_fixtures_and_odd_graphs(spark):
    lex = connected_components(edges_df(spark, EXAMPLE, "string"), strategy="contract")
    assert rows(lex.membership(), "node", "component") == [("B", "A"), ("C", "A"), ("D", "A"), ("E", "A"), ("G", "F"), ("H", "F")]
    odd = connected_components(edges_df(spark, [(1, 2), (2, 1), (3, 3), (None, 4), (7, 8)]), strategy="contract")
    assert rows(odd.membership(), "node", "component") == [(2, 1), (8, 7)]
    empty = connected_components(edges_df(spark, [(5, 5)]), strategy="contract")
    assert empty.pairs.count() == 0 and empty.trace == [(1, 0, 0)]
    with pytest.raises(RuntimeError):
        connected_components(edges_df(spark, chain(50)), strategy="contract", max_rounds=1)


def test_contraction_of_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    res = connected_components(e, strategy="contract")
    assert len(res.trace) <= 2 * n.bit_length() and all(p < n for _, _, p in res.trace)
    got = res.membership().agg(F.count(F.lit(1)), F.countDistinct("node"), F.max("component")).first()
    assert tuple(got) == (n - 1, n - 1, 0)


@pytest.mark.parametrize("strategy", ["join", "sorted"])
def test_a_killed_run_is_resumed(spark, monkeypatch, strategy):
    """The loop dies in round 3; the next call neither reads the input nor runs rounds 1 and 2 again."""
    import linkfold.operators.components as cc
    e = random_graph(200, 210, 5) + chain(40)
    want = connected_components(edges_df(spark, e), strategy=strategy)
    real, calls = cc.round_output, []

    def dying(*a, **k):
        calls.append(len(calls))
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*a, **k)

    monkeypatch.setattr(cc, "round_output", dying)
    name = f"killed-{strategy}"
    with pytest.raises(KeyboardInterrupt):
        connected_components(edges_df(spark, e), strategy=strategy, resume=name)
    monkeypatch.setattr(cc, "round_output", lambda *a, **k: (calls.append("again"), real(*a, **k))[1])
    monkeypatch.setattr(cc, "write_table", lambda df, path, w=cc.write_table: w(df, path) if "cc-r0" not in path else 1 / 0)
    res = connected_components(edges_df(spark, e), strategy=strategy, resume=name)
    assert res.trace == want.trace and rows(res.membership(), "node", "component") == membership_of(e)
    assert calls.count("again") == len(want.trace) - 3    # not rounds 1 and 2, and the last is only recorded
    done = connected_components(edges_df(spark, e), strategy=strategy, resume=name)     # a finished run gives its result again
    assert done.trace == want.trace and rows(done.membership(), "node", "component") == membership_of(e)
    folder = res.run.folder.replace("file:", "")
    assert os.path.exists(folder)
    res.release()
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        connected_components(edges_df(spark, e), resume="../x")


def test_hot_threshold_bound():
    assert hot_threshold(10**9, max_hot_keys=1000, min_hot_degree=10) == 10**6
    assert hot_threshold(100, max_hot_keys=1000, min_hot_degree=10) == 10
    with pytest.raises(ValueError):
        hot_threshold(10**6, hot_degree=10, max_hot_keys=1000)


def test_edge_cases(spark):
    empty = connected_components(edges_df(spark, []))
    assert empty.pairs.count() == 0 and empty.trace == [(1, 0, 0)]
    loop = connected_components(edges_df(spark, [(5, 5)]))
    assert loop.pairs.count() == 0
    dup = connected_components(edges_df(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (3, 2)]))
    assert rows(dup.membership(), "node", "component") == [(2, 1), (3, 1)]
    nulls = connected_components(edges_df(spark, [(1, None), (None, 2), (4, 3)]))
    assert rows(nulls.membership(), "node", "component") == [(4, 3)]
    big = 2**40
    wide = connected_components(edges_df(spark, [(big + 1, big), (big + 2, big + 1)]))
    assert rows(wide.membership(), "node", "component") == [(big + 1, big), (big + 2, big)]


def test_max_rounds_raises(spark):
    with pytest.raises(RuntimeError):
        connected_components(edges_df(spark, chain(50)), max_rounds=2)


def test_include_roots(spark):
    res = connected_components(edges_df(spark, [(2, 1), (3, 2)]))
    assert rows(res.membership(include_roots=True), "node", "component") == [(1, 1), (2, 1), (3, 1)]


def test_isolated_vertices(spark):
    res = connected_components(edges_df(spark, [(2, 1), (7, 7)]))
    v = spark.createDataFrame([(1,), (2,), (7,), (9,)], "node long")
    got = rows(res.membership(include_roots=True, vertices=v), "node", "component")
    assert got == [(1, 1), (2, 1), (7, 7), (9, 9)]


def test_release_deletes_the_result_table(spark):
    res = connected_components(edges_df(spark, TWO_GRAPHS))
    local = res.path.replace("file:", "")
    assert os.path.exists(local) and res.membership().count() == 11
    res.release()
    assert res.path is None and not os.path.exists(local)


@pytest.mark.parametrize("name", ["connected_components", "component_sizes", "components_lexical"])
def test_membership_queries_write_no_more_rows_than_the_graph_has_edges(spark, monkeypatch, name):
    """The star rounds of E1 write 9,645 pairs for 6,000 line items at this size, and 3.0 times the edges at sf0.1."""
    import __spark_entry__ as entry
    import linkfold.operators.components as cc
    import linkfold.operators.contraction as contraction
    from conftest import SF0001
    from linkfold.storage import scratch, write_table
    sizes = []

    def counted(df, path):
        out = write_table(df, path)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cc, "write_table", counted)
    monkeypatch.setattr(contraction, "write_table", counted)
    n_edges = spark.read.parquet(f"{SF0001}/lineitem.parquet").count()
    with scratch(spark):
        assert entry.queries()[name](spark, SF0001).count() > 0
    assert sizes and max(sizes) <= n_edges


@pytest.mark.parametrize("opts", [{}, {"min_hot_degree": 4, "max_hot_keys": 1000}])
def test_contraction_of_text_ids_moves_numbers_and_keeps_their_order(spark, monkeypatch, opts):
    import linkfold.operators.contraction as contraction
    e = random_graph(120, 110, 3) + hub(60)
    text = [(str(a), str(b)) for a, b in e]
    kinds, real = [], contraction.representatives
    monkeypatch.setattr(contraction, "representatives", lambda df, seed: (kinds.append(dict(df.dtypes)), real(df, seed))[1])
    res = connected_components(edges_df(spark, text, "string"), strategy="contract", **opts)
    assert rows(res.membership(), "node", "component") == membership_of(text)
    assert kinds and all(k == {"n1": "bigint", "n2": "bigint"} for k in kinds)
    none = connected_components(edges_df(spark, [("a", "a")], "string"), strategy="contract").membership()
    assert none.dtypes == [("node", "string"), ("component", "string")] and none.count() == 0
