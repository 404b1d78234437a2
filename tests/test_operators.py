import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from linkfold.operators import kmeans as km
from linkfold.operators.keyed import attach_group_min
from linkfold.operators.ordering import (chunked_lists, ordered, partition_carries, partition_profile, previous_in_group,
                                         rank_in_group, row_index, running_totals, sorted_sets)
from linkfold.operators.reports import component_members, top_components
from linkfold.sources.edges import (duplicate_doc_edges, edge_report, embedding_vectors, order_part_edges,
                                    read_edges_csv, read_edges_text, read_vectors_csv, vector_report,
                                    write_edges_text)
from linkfold.storage import scratch


def test_row_index_is_contiguous_in_order(spark):
    e = order_part_edges(spark, SF0001)
    got = sorted((r.idx, r.src, r.dst) for r in row_index(e, ["src", "dst"], num_partitions=5).collect())
    want = sorted((r.src, r.dst) for r in e.collect())
    assert [i for i, _, _ in got] == list(range(len(want)))
    assert [(s, d) for _, s, d in got] == want


@pytest.mark.parametrize("parts", [None, 3, 200])
def test_previous_in_group_with_one_hot_group_across_partitions(spark, parts):
    # one group holds 90% of the rows, so range partitions split it; with 200 partitions
    # most hold a few rows and a group's rows cross many partition boundaries
    rows = [("hot", i) for i in range(0, 900, 1)] + [(f"g{i % 7}", 1000 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "h string, d long").repartition(6)
    got = {(r.h, r.d): r.prev for r in previous_in_group(df, "h", "d", num_partitions=parts).collect()}
    want = {}
    for h in {h for h, _ in rows}:
        ds = sorted(d for g, d in rows if g == h)
        for i, d in enumerate(ds):
            want[(h, d)] = ds[i - 1] if i else None
    assert got == want


def test_duplicate_doc_edges_match_a_lag(spark):
    import pandas as pd
    docs = pd.read_parquet(f"{SF0001}/documents.parquet", columns=["doc_id", "text"])
    import hashlib
    docs["h"] = docs.text.map(lambda t: hashlib.md5(t.encode()).hexdigest())
    docs = docs.sort_values(["h", "doc_id"])
    docs["prev"] = docs.groupby("h").doc_id.shift(1)
    want = sorted((int(a), int(b)) for a, b in docs.dropna()[["doc_id", "prev"]].values)
    got = sorted(tuple(r) for r in duplicate_doc_edges(spark, SF0001).collect())
    assert got == want


@pytest.mark.parametrize("cold", ["window", "join"])
def test_attach_group_min_hot_and_cold(spark, cold):
    rows = [(0, i) for i in range(1, 200)] + [(i, i + 5) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "n1 long, n2 long")
    want = {}
    for k, v in rows:
        want[k] = min(want.get(k, v), v)
    for opts in [{}, {"min_hot_degree": 10, "max_hot_keys": 1000}]:
        got = attach_group_min(df, "n1", "n2", cold=cold, **opts).collect()
        assert len(got) == len(rows)
        assert all(r.mn == want[r.n1] for r in got)


def test_text_and_csv_readers(spark, tmp_path):
    e = order_part_edges(spark, SF0001)
    want = sorted((r.src, r.dst) for r in e.collect())
    write_edges_text(e, str(tmp_path / "t"), sep="\t", preamble=["# header one", "# header two"])
    got = read_edges_csv(spark, [str(tmp_path / "t" / "preamble"), str(tmp_path / "t" / "edges")],
                         sep="\t", comment="#")
    assert sorted((r.src, r.dst) for r in got.collect()) == want
    txt = read_edges_text(spark, str(tmp_path / "t" / "edges"))
    assert dict(txt.dtypes) == {"src": "string", "dst": "string"}
    write_edges_text(e, str(tmp_path / "h"), sep=",", header=True)
    got = read_edges_csv(spark, str(tmp_path / "h" / "edges"), header=True)
    assert sorted((r.src, r.dst) for r in got.collect()) == want


@pytest.mark.parametrize("text,good,short,unreadable", [
    ("A,B\nB,C\nD,E\n", [], 0, 3),                            # letters read as numbers
    ("1,2\n3\n4,5,6\n", [(1, 2), (4, 5)], 1, 0),              # a short line; a field too many is no fault
    ("1,2\n2,x3\n\n4,5\n7,\n", [(1, 2), (4, 5)], 1, 1),      # a blank line is no row
    ("1,99999999999999999999\n1,2\n", [(1, 2)], 0, 1),        # beyond the id type
])
def test_no_row_is_lost_in_silence(spark, tmp_path, text, good, short, unreadable):
    path = str(tmp_path / "e.csv")
    (tmp_path / "e.csv").write_text(text)
    with pytest.raises(Exception, match="edge row"):
        read_edges_csv(spark, path).collect()
    with pytest.raises(Exception, match="edge row"):
        read_edges_csv(spark, path).count()
    assert sorted(tuple(r) for r in read_edges_csv(spark, path, on_bad="drop").collect()) == good
    assert tuple(edge_report(spark, path).first()) == (len(good) + short + unreadable, short, unreadable)


@pytest.mark.parametrize("split", [None, "64"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_lead_lines_are_skipped_by_number(spark, tmp_path, monkeypatch, split, broadcast):
    import linkfold.sources.edges as src
    if not broadcast:
        monkeypatch.setattr(src, "MAX_STARTS", 2)
    for k in range(3):
        lines = ["head one", "1\t1", "", "head four"] + [f"{k}\t{i}" for i in range(100)]
        (tmp_path / f"f{k}.tsv").write_text("\n".join(lines))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as with many files
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = read_edges_csv(spark, str(tmp_path), sep="\t", skip_lines=4)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in df.collect())
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert got == sorted((k, i) for k in range(3) for i in range(100))
    if broadcast:   # one row per file is sent out; no line is shuffled
        assert plan.count("Exchange") == 1 and "BroadcastExchange" in plan and "SortMergeJoin" not in plan


def test_vector_csv_reader(spark, tmp_path):
    (tmp_path / "iris.csv").write_text("5.1,3.5,1.4,0.2,setosa\n6.2,2.9,4.3,1.3,versicolor\n")
    v = read_vectors_csv(spark, str(tmp_path / "iris.csv"))
    rows = sorted((r.label, r.features) for r in v.collect())
    assert rows == [("setosa", [5.1, 3.5, 1.4, 0.2]), ("versicolor", [6.2, 2.9, 4.3, 1.3])]


def test_vector_csv_bad_rows(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("1.5,2,a\n,2,b\n3,x,c\n4,5\n\n6,7,d,more\n8,nine,e\n")
    report = vector_report(spark, str(path), n_features=2).first()
    assert tuple(report) == (6, 2, 2)
    kept = read_vectors_csv(spark, str(path), n_features=2, on_bad="drop").collect()
    assert sorted((r.label, r.features) for r in kept) == [("a", [1.5, 2.0]), ("d", [6.0, 7.0])]
    for col in ("features", "label"):      # whichever column is read
        with pytest.raises(Exception, match="(short|unreadable) vector row"):
            read_vectors_csv(spark, str(path), n_features=2).select(col).collect()
    with pytest.raises(ValueError):
        read_vectors_csv(spark, str(path), on_bad="skip")


def test_sql_functions_of_several_id_types_live_together(spark):
    from linkfold.functions.sql import register_relabel
    longs = spark.createDataFrame([(9, 1, 1), (9, 1, 4)], "n1 long, mn long, n2 long")
    texts = spark.createDataFrame([("z", "a", "a"), ("z", "a", "k")], "n1 string, mn string, n2 string")
    of_long, of_text = register_relabel(longs), register_relabel(texts)
    assert of_long != of_text
    for df, fn, want in ((longs, of_long, [9, 4]), (texts, of_text, ["z", "k"])):     # both after both are registered
        assert [r[0] for r in spark.sql(f"SELECT {fn}(n1, mn, n2) AS n1 FROM {{m}}", m=df).collect()] == want


def test_partition_profile_follows_the_partitioner(spark):
    df = spark.createDataFrame([(i,) for i in [-1, 0, 1, 5, 10, 15, 16]], "k long")
    assert sorted(tuple(r) for r in partition_profile(df, "k", 5).collect()) == [(0, 4), (1, 2), (4, 1)]


@pytest.mark.parametrize("parts", [None, 3, 40])
def test_rank_in_group_with_one_hot_group_across_partitions(spark, parts):
    rows = [("hot", i) for i in range(700)] + [(f"g{i % 7}", i) for i in range(90)] + [("hot", 5), (None, 1), (None, 2)]
    got = sorted((str(r.g), r.v, r.rnk) for r in rank_in_group(
        spark.createDataFrame(rows, "g string, v long").repartition(5), "g", "v", num_partitions=parts).collect())
    want = []
    for g in {g for g, _ in rows}:
        want += [(str(g), v, i) for i, v in enumerate(sorted(v for h, v in rows if h == g))]
    assert got == sorted(want)


def test_carries_are_one_row_per_partition(spark):
    """One group over 400 range partitions: as many carry rows as partitions, not their square."""
    rows = [("a", 1)] + [("hot", i) for i in range(2000)] + [("z", i) for i in range(3)]
    t = ordered(spark.createDataFrame(rows, "g string, v long"), ["g", "v"], 400)
    carries = partition_carries(t, {"n": F.lit(1)}, ["g"])
    n_parts = t.select("_pid").distinct().count()
    assert n_parts > 300 and carries.count() == n_parts
    plan = carries._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.g, r.v, r.n) for r in running_totals(t, {"n": F.lit(1)}, ["g"]).collect())
    assert got == sorted((g, v, v if g != "a" else 0) for g, v in rows)


@pytest.mark.parametrize("parts", [None, 2, 60])
def test_running_totals_against_a_loop(spark, parts):
    import random
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(4)
    got = {(r.g, r.o): (r.s, r.n) for r in running_totals(ordered(df, ["g", "o"], parts), {"s": F.col("v"), "n": F.lit(1)}, ["g"]).collect()}
    want, seen = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[g, o] = seen.get(g, (0, 0))
        seen[g] = (want[g, o][0] + v, want[g, o][1] + 1)
    assert got == want
    whole = {r.o: r.s for r in running_totals(ordered(df, ["o"], parts), {"s": F.col("v")}).collect()}
    assert whole == {o: sum(r[2] for r in rows[:o]) for _, o, _ in rows}


@pytest.mark.parametrize("parts", [None, 50])
def test_sorted_sets_drop_repeats_across_partitions(spark, parts):
    rows = [("hot", 7)] * 400 + [("hot", i) for i in range(25)] + [("b", 2), ("b", 2), ("b", 1), (None, 3), (None, 3), ("n", None)]
    got = {(r.g, r.chunk): r["values"] for r in
           sorted_sets(spark.createDataFrame(rows, "g string, v long").repartition(5), "g", "v", size=10, num_partitions=parts).collect()}
    assert got == {("hot", 0): list(range(10)), ("hot", 1): list(range(10, 20)), ("hot", 2): list(range(20, 25)),
                   ("b", 0): [1, 2], (None, 0): [3], ("n", 0): []}


def test_row_index_stores_only_order_and_position(spark, tmp_path):
    rows = [(i, i * 37 % 100 // 2, f"a long text {i}" * 5) for i in range(100)]
    spark.createDataFrame(rows, "key long, v long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    with scratch(spark, keep=True) as owned:
        got = sorted((r.idx, r.v, r.key, r.text) for r in
                     row_index(df, ["v"], num_partitions=4, position=["_metadata.file_path", "_metadata.row_index"]).collect())
        stored = [spark.read.parquet(p).columns for p in owned.paths]
    owned.release()
    assert [g[0] for g in got] == list(range(100)) and [g[1] for g in got] == sorted(r[1] for r in rows)
    assert sorted((k, v, t) for _, v, k, t in got) == rows
    assert stored == [["_o0", "_k0", "_k1", "_mid"]]


def test_lists_are_whole_up_to_their_size_for_any_type(spark):
    big = 2**62 + 1023
    rows = [(1, big), (1, 3), (1, 3), (2, -5)] + [(3, i) for i in range(25)]
    got = {(r.k, r.chunk): r["values"] for r in chunked_lists(spark.createDataFrame(rows, "k long, v long"), "k", "v", size=10).collect()}
    assert got == {(1, 0): [3, 3, big], (2, 0): [-5], (3, 0): list(range(10)), (3, 1): list(range(10, 20)), (3, 2): list(range(20, 25))}
    text = chunked_lists(spark.createDataFrame([("x", "b"), ("x", "10"), ("x", "9")], "k string, v string"), "k", "v")
    assert [tuple(r) for r in text.collect()] == [("x", 0, ["10", "9", "b"])]


def test_member_lists_of_string_ids(spark):
    m = spark.createDataFrame([("b", "a"), ("c", "a"), ("z", "y")], "node string, component string")
    assert sorted(tuple(r) for r in component_members(m).collect()) == [("a", 0, "a,b,c"), ("y", 0, "y,z")]


def test_duplicate_documents_scan_texts_once(spark):
    plan = duplicate_doc_edges(spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan     # the hashes are a stored table; no text is read again


def test_member_lists_are_chunked_and_whole(spark):
    m = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(5001, 5000)], "node long, component long")
    rows = component_members(m, chunk=1000).collect()
    assert max(len(r.members.split(",")) for r in rows) <= 1000
    ids = sorted(int(x) for r in rows for x in r.members.split(","))
    assert ids == list(range(0, 3000)) + [5000, 5001]


def test_top_components_ties_break_on_id(spark):
    m = spark.createDataFrame([(2, 1), (4, 3), (6, 5), (7, 5)], "node long, component long")
    assert [tuple(r) for r in top_components(m, 2).collect()] == [(5, 3), (1, 2)]


def _numpy_kmeans(x, centers, max_steps=100, digits=9):
    """Reference loop for the tests: same rules as the Spark operator."""
    cids = sorted(centers)
    prev = None
    for step in range(max_steps + 1):
        cs = [c for c in cids if c in centers]
        d = np.sqrt(((x[:, None, :] - np.array([centers[c] for c in cs])[None]) ** 2).sum(-1))
        key = np.round(d, digits)
        a = np.array([cs[i] for i in key.argmin(1)])
        dist = d[np.arange(len(x)), key.argmin(1)]
        moved = len(x) if prev is None else int((a != prev).sum())
        if moved == 0 or step == max_steps:
            return a, math.sqrt(dist.sum()) / len(x), step
        centers = {c: np.round(x[a == c].mean(0), digits) for c in cs if (a == c).any()}
        prev = a


def test_kmeans_against_numpy(spark):
    pts = embedding_vectors(spark, SF0001)
    rows = sorted((r.id, r.features) for r in pts.collect())
    x = np.array([f for _, f in rows])
    c0 = km.collect_centers(km.init_by_ids(pts, [0, 1, 2]))
    want_a, want_err, want_steps = _numpy_kmeans(x, {c: np.array(v) for c, v in c0})
    res = km.kmeans(pts, c0)
    got = dict((r.id, r.cid) for r in res.assignment.collect())
    assert res.steps == want_steps
    assert abs(res.error - want_err) < 1e-9
    assert [got[i] for i, _ in rows] == list(want_a)


def test_kmeans_k1_empty_cluster_and_tie(spark):
    pts = spark.createDataFrame([(i, [float(i), 0.0], "x") for i in range(6)],
                                "id long, features array<double>, label string")
    one = km.kmeans(pts, [(0, [0.0, 0.0])])
    assert one.steps == 1 and {r.cid for r in one.assignment.collect()} == {0}
    far = km.kmeans(pts, [(0, [0.0, 0.0]), (1, [1000.0, 1000.0])])
    assert [c for c, _ in far.centers] == [0]            # the empty cluster disappears
    tie = km.assign(pts, [(3, [2.5, 1.0]), (1, [2.5, -1.0])])
    assert {r.cid for r in tie.collect()} == {1}        # equal distances: lowest cid


def test_switches_and_error(spark):
    pts = spark.createDataFrame([(0, [0.0], "a"), (1, [1.0], "a"), (2, [4.0], "b")],
                                "id long, features array<double>, label string")
    assert km.switches(pts, [(0, [0.0]), (1, [4.0])], [(0, [0.0]), (1, [0.9])]).first()[0] == 1
    e = km.error(km.assign(pts, [(0, [0.0]), (1, [4.0])])).first()[0]
    assert abs(e - math.sqrt(1.0) / 3) < 1e-12


@pytest.mark.parametrize("odd", [[1.0, 2.0, 3.0], [1.0], None])
def test_vectors_of_another_size_end_the_run(spark, odd):
    pts = spark.createDataFrame([(0, [0.0, 0.0], "a"), (1, [1.0, 1.0], "a"), (2, odd, "b")],
                                "id long, features array<double>, label string")
    with pytest.raises(Exception, match="elements, not 2"):
        km.kmeans(pts, [(0, [0.0, 0.0]), (1, [1.0, 1.0])])
    with pytest.raises(Exception, match="elements, not 2"):
        km.assign(pts, [(0, [0.0, 0.0])]).collect()


def test_a_run_that_hits_max_steps_says_so(spark):
    pts = embedding_vectors(spark, SF0001)
    c0 = km.collect_centers(km.init_by_ids(pts, [0, 1, 2]))
    assert not km.kmeans(pts, c0, max_steps=1).converged and km.kmeans(pts, c0).converged


def test_initial_ids_must_exist(spark):
    with pytest.raises(ValueError, match="-7"):
        km.init_by_ids(embedding_vectors(spark, SF0001), [0, -7])


def test_kmeans_step_plan_has_one_exchange_and_no_join(spark):
    """Points never meet the centroids in a join: one partial + final aggregation, with one vector sum whatever the width."""
    from linkfold.functions.vectors import centers_json
    pts = embedding_vectors(spark, SF0001).select("features")
    c0 = km.collect_centers(km.init_by_ids(embedding_vectors(spark, SF0001), [0, 1, 2]))
    dims = len(c0[0][1])
    args = {"cur": centers_json(c0), "old": centers_json(c0)}
    saved = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        anchor = spark.sql(km._anchor_sql(dims, 9, False), args=args, pts=pts)
        still = {"now": km._moves(c0, c0), "was": km._moves(c0, c0)}
        df = km._step_aggregates(spark.sql(km._step_sql(dims, 9), args=args | still, pts=anchor))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum(r["sw"] for r in df.collect()) == 0   # same centroids: nobody moves
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", saved)
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Cartesian" not in plan
    final = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert final.count("sum(") <= 4 and final.lower().count("summary") <= 2 and len(final) < 2000     # not one aggregate a dimension


def test_wide_vectors(spark):
    dims = 4096
    pts = spark.range(12).select("id", F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.col("id") % 2 * 100 + i % 7).cast("double")).alias("features"),
                                 F.lit("x").alias("label"))
    res = km.kmeans(pts, km.init_by_ids(pts, [0, 1]))
    assert res.converged and [len(v) for _, v in res.centers] == [dims, dims] and res.centers[1][1][:3] == [101.0, 102.0, 103.0]
    got = {r.cid: (r.n, r.sums[0]) for r in km.cluster_aggregates(km.assign(pts, res.centers)).collect()}
    assert got == {0: (6, 6.0), 1: (6, 606.0)}


@pytest.mark.parametrize("k", [3, 12])
def test_bounds_save_distances_and_change_nothing(spark, k):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 10, (k, 5))
    x = np.concatenate([c + rng.normal(0, 2.5, (60, 5)) for c in centers])
    pts = spark.createDataFrame([(i, [float(a) for a in v], "x") for i, v in enumerate(x)], "id long, features array<double>, label string")
    c0 = km.collect_centers(km.init_by_sample(pts, k))
    want_a, want_err, want_steps = _numpy_kmeans(x, {c: np.array(v) for c, v in c0})
    res = km.kmeans(pts, c0)
    got = dict((r.id, r.cid) for r in res.assignment.collect())
    assert (res.steps, [got[i] for i in range(len(x))]) == (want_steps, list(want_a)) and abs(res.error - want_err) < 1e-9
    assert len(res.evaluations) == want_steps + 1 and res.evaluations[0] == k * len(x)
    assert sum(res.evaluations) < 0.7 * 2 * k * len(x) * (want_steps + 1)      # all distances under two sets of centroids


def test_hash_bound_leaves_about_k_rows(spark):
    from linkfold.operators.sampling import hash_bound, least_by_hash
    df = spark.range(0, 50_000, 1, 40)
    order = km.sample_order("id", 42)
    for k in (1, 700, 20_000):
        bound = hash_bound(df, order, k, 0, km.SAMPLE_MODULUS - 1, cells=64)
        assert k <= df.where(order <= bound).count() <= 1.1 * k + 1
        want = sorted(range(50_000), key=lambda i: (i * 1103515245 + 42) % 2**31)[:k]
        got = least_by_hash(df, order, k, 0, km.SAMPLE_MODULUS - 1, ["id"], cells=64)
        assert [r[0] for r in got.collect()] == want
    assert hash_bound(df, order, 50_000, 0, km.SAMPLE_MODULUS - 1) is None
    h = F.xxhash64("id")
    bound = hash_bound(df, h, 300, -2**63, 2**63 - 1)
    assert 300 <= df.where(h <= bound).count() <= 331
    same = df.select(F.lit(7).cast("long").alias("id"))       # one hash for all rows: the ties decide
    assert least_by_hash(same, km.sample_order("id", 42), 5, 0, km.SAMPLE_MODULUS - 1, ["id"]).count() == 5


def test_secondary_sort_splits_a_hub_and_sorts_partitions(spark):
    from linkfold.operators.ordering import secondary_sort
    rows_ = [(1, v) for v in range(2000)] + [(k, 0) for k in range(2, 50)]
    df = spark.createDataFrame(rows_, "k long, v long")
    out = secondary_sort(df, ["k", "v"], 4).select(F.spark_partition_id().alias("p"), "k", "v")
    got = [tuple(r) for r in out.collect()]
    parts = {}
    for p, k, v in got:
        parts.setdefault(p, []).append((k, v))
    assert all(rs == sorted(rs) for rs in parts.values())
    assert len({p for p, k, _ in got if k == 1}) > 1        # the hub spans partitions
    assert sorted((k, v) for _, k, v in got) == sorted(rows_)


def test_files_with_lead_lines_are_written_without_a_shuffle(spark, monkeypatch, tmp_path):
    """The edges went through one sort per file, and there were three files whatever their number."""
    import linkfold.plans.catalog as cat
    path = str(tmp_path / "lead")
    monkeypatch.setattr(cat, "LEAD_FILE_EDGES", 1000, raising=False)
    monkeypatch.setattr(cat, "new_scratch_path", lambda spark, tag: path)
    got = cat.q_scan_skip_lines(spark, SF0001)
    want = cat.edges(spark, SF0001)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    files = [f.read_text().splitlines() for f in (tmp_path / "lead").rglob("part-*.txt")]
    assert len(files) >= want.count() / 1000
    assert all(f[:4] == ["Undirected graph", "Nodes and edges", "From\tTo", "17\t4"] and 4 < len(f) <= 1004 for f in files)


@pytest.mark.parametrize("old", [[(0, [0.5, 0.0]), (2, [4.0, 3.0]), (5, [9.0, 9.0])], [(0, [0.0, 0.0]), (2, [5.0, 3.0])]])
def test_kmeans_steps_over_batches_as_in_sql(spark, old):
    """Points that are sure, that are compared again, ties, and a cluster that is gone: each batch step gives the rows of the SQL step."""
    from linkfold.functions.vectors import centers_json
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 4, (300, 2)), [[2.5, 1.5], [0.0, 0.0], [4.5, 6.0]]])
    pts = spark.createDataFrame([([float(a) for a in v],) for v in x], "features array<double>").repartition(3).persist()
    base, cur = [(0, [0.0, 0.0]), (2, [5.0, 3.0]), (5, [9.0, 9.0])], [(0, [0.25, 0.0]), (2, [4.5, 3.0])]
    args = {"cur": centers_json(cur), "old": centers_json(old), "now": km._moves(base, cur), "was": km._moves(base, old)}
    anchor_sql = spark.sql(km._anchor_sql(2, 9, False), args={"cur": centers_json(base), "old": centers_json(old)}, pts=pts)
    anchor = pts.mapInArrow(km._anchor_batches(base, old, 9), km.ANCHOR_SCHEMA)
    rounded = lambda df: sorted((r.c0, round(r.d0, 9), round(r.l0, 9), r.sw0) for r in df.collect())
    assert rounded(anchor) == rounded(anchor_sql)
    total = lambda df: {r.cid: (r.n, round(r.sum_dist, 6), r.sw, r.crossed, [round(v, 6) for v in r.sums]) for r in df.collect()}
    want = total(km._step_aggregates(spark.sql(km._step_sql(2, 9), args=args, pts=anchor_sql)))
    assert total(km._totals(anchor.mapInArrow(km._step_batches(cur, old, base, 2, 9, False), km.PART_SCHEMA))) == want
    assert 0 < sum(r[3] for r in want.values()) < 2 * len(x)


def test_kmeans_loop_evaluates_no_lambdas(spark, monkeypatch):
    """No step of the loop computes distances in SQL, where each element of each vector is a lambda call."""
    pts = embedding_vectors(spark, SF0001)
    c0 = km.collect_centers(km.init_by_ids(pts, [0, 1, 2]))
    plans = []
    monkeypatch.setattr(km, "_totals", lambda df, t=km._totals: (plans.append(df._jdf.queryExecution().analyzed().toString()), t(df))[1])
    assert km.kmeans(pts, c0).steps == len(plans) - 1
    assert plans and not any("lambda" in p for p in plans)


def test_a_null_element_ends_the_run(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0], "a"), (1, [1.0, None], "a")], "id long, features array<double>, label string")
    with pytest.raises(Exception, match="element that is null"):
        km.kmeans(pts, [(0, [0.0, 0.0]), (1, [1.0, 1.0])])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_mirror_distinct_holds_each_pair_once(spark, tmp_path, kind):
    """Both directions of every pair, from one scan and one de-duplicated row a pair; loops once, null ids as in a plain union."""
    from linkfold.operators.pairs import mirror_distinct, mirror_union
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (10, 9), (None, 1), (1, None), (None, None), (None, 5), (7, 1)]
    spark.createDataFrame(pairs, "n1 long, n2 long").selectExpr(f"cast(n1 as {kind}) n1", f"cast(n2 as {kind}) n2").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    out = mirror_distinct(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, mirror_union(df).distinct().collect()), key=key)
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    assert plan.index("Generate") < plan.index("HashAggregate")      # mirrored after the de-duplication
