"""DuckDB SQL oracles, one per registered query that SQL can express.

They share no code with the Spark side: component membership of E3 is checked by recursive
reachability (quadratic in the component's size), of the large graphs and, like traces and round states, by
unrolled rounds (a converged pair set is a fixed point, so extra rounds are harmless), k-means by unrolled
steps (a converged assignment is a fixed point too). Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

# fixed values shared with the Spark side
CHUNK = 1024              # ids per list row
UNROLLED_ROUNDS = 14      # component rounds in the trace / state oracles
KMEANS_STEPS = 100        # step cap of the k-means loop

E1 = "select l_orderkey * 2 as src, l_partkey * 2 + 1 as dst from lineitem"
E2 = ("select user_id * 2 as src, cast(json_extract_string(props, '$.k') as bigint) * 2 + 1 as dst "
      "from events where json_extract_string(props, '$.k') is not null")
E3 = ("select src, dst from (select doc_id as src, lag(doc_id) over "
      "(partition by md5(text) order by doc_id) as dst from documents where text is not null) "
      "where dst is not null")
E1_TEXT = f"select cast(src as varchar) as src, cast(dst as varchar) as dst from ({E1})"
E3_TEXT = f"select cast(src as varchar) as src, cast(dst as varchar) as dst from ({E3})"
GRAPH = {"e1": E1, "e2": E2, "e3": E3, "e1_text": E1_TEXT}


def _pairs(g: str) -> str:
    return f"select src as n1, dst as n2 from ({GRAPH[g]}) where src is not null and dst is not null"


def _mirror(g: str) -> str:
    return f"select n1, n2 from ({_pairs(g)}) union select n2, n1 from ({_pairs(g)})"


def _reach(edges_sql: str) -> str:
    return f"""
with recursive e as ({edges_sql}),
u as (select src as a, dst as b from e where src is not null and dst is not null
      union select dst, src from e where src is not null and dst is not null),
r(n, c) as (select a, a from u union select r.n, u.b from r join u on r.c = u.a)
select n as node, min(c) as component from r group by n having min(c) < n"""


def _rounds(g: str, n: int) -> str:
    ctes = [f"g0 as ({_pairs(g)})"]
    for i in range(1, n + 1):
        ctes += [
            f"s{i} as materialized (select n1, n2 from g{i-1} union select n2, n1 from g{i-1})",
            f"m{i} as materialized (select n1, min(n2) as mn, count(*) as k from s{i} "
            f"group by n1 having min(n2) < n1)",
            f"p{i} as materialized (select s.n2 as n1, m.mn as n2 from s{i} s join m{i} m using (n1) "
            f"where s.n2 <> m.mn union all select n1, mn from m{i})",
            f"g{i} as materialized (select distinct n1, n2 from p{i})",
        ]
    return "with " + ",\n".join(ctes)


def _trace(g: str, n: int = UNROLLED_ROUNDS) -> str:
    rows = " union all ".join(
        f"select {i} as rnd, (select coalesce(sum(k - 1), 0) from m{i}) as np, "
        f"(select count(*) from g{i}) as pc" for i in range(1, n + 1))
    return (_rounds(g, n) + f",\nt as ({rows})\n"
            "select cast(rnd as integer) as round, cast(np as bigint) as new_pairs, "
            "cast(pc as bigint) as pairs from t "
            "where rnd <= (select min(rnd) from t where np = 0)")


def _membership(g: str) -> str:
    if g == "e3":
        return _reach(GRAPH[g])
    return _rounds(g, UNROLLED_ROUNDS) + f"\nselect n1 as node, n2 as component from g{UNROLLED_ROUNDS}"


def _with_min(g: str = "e1") -> str:
    return (f"with s as ({_mirror(g)}), m as (select n1, min(n2) as mn from s group by n1) "
            f"select s.n1, s.n2, m.mn from s join m using (n1)")


def _ranked(key: str, val: str, src: str) -> str:
    return (f"select {key}, {val}, (row_number() over (partition by {key} order by {val}) - 1) // {CHUNK} as chunk "
            f"from ({src})")


def _list(key: str, val: str, src: str, out: str) -> str:
    return (f"select {key}, cast(chunk as bigint) as chunk, array_to_string(list({val} order by {val}), ',') as {out} "
            f"from ({_ranked(key, val, src)}) group by {key}, chunk")


PTS = ("select vec_id as id, cast(embedding as double[]) as f, cast(label as varchar) as label "
       "from embeddings")


def _km_ctes(steps: int) -> str:
    ctes = [f"pts as materialized ({PTS})",
            "c0 as materialized (select cast(row_number() over (order by id) - 1 as integer) as cid, "
            "f as center from pts where id in (0, 1, 2))"]
    for t in range(0, steps + 1):
        ctes.append(
            f"a{t} as materialized (select p.id, arg_min(c.cid, (round(list_distance(p.f, c.center), 9), c.cid)) as cid, "
            f"min_by(list_distance(p.f, c.center), (round(list_distance(p.f, c.center), 9), c.cid)) as dist "
            f"from pts p, c{t} c group by p.id)")
        if t < steps:
            ctes.append(
                f"c{t+1} as materialized (select cid, list(v order by i) as center from ("
                f"select a.cid, i, round(avg(p.f[i]), 9) as v from a{t} a join pts p using (id), "
                f"generate_series(1, len(p.f)) g(i) group by a.cid, i) group by cid)")
    return "with " + ",\n".join(ctes)


# the seeded sample order of the k-means operator, in DuckDB integer arithmetic
_SAMPLE_ORDER = "((((({id}) % 2147483648) + 2147483648) % 2147483648) * 1103515245 + 42) % 2147483648, {id}"


def _km_long(center_sql: str, col: str = "value") -> str:
    return (f"select cast(cid as integer) as cid, cast(i - 1 as integer) as dim, "
            f"round(center[i], 6) as {col} from ({center_sql}) x, generate_series(1, len(center)) g(i)")


def _km_final(steps: int = KMEANS_STEPS) -> str:
    sw = " union all ".join(
        f"select {t} as step, (select count(*) from a{t} x join a{t-1} y using (id) "
        f"where x.cid <> y.cid) as sw" for t in range(1, steps + 1))
    return _km_ctes(steps) + f",\nsw as ({sw}),\nstop as (select coalesce(min(step), {steps}) as s from sw where sw = 0)"


def _kmeans_final_assignment() -> str:
    # the assignment at the stop step equals the one after the last unrolled step (fixed point)
    return _km_ctes(KMEANS_STEPS) + (f"\nselect id, cast(cid as integer) as cid, round(dist, 6) as dist "
                                     f"from a{KMEANS_STEPS}")


def _kmeans_steps() -> str:
    errs = " union all ".join(
        f"select {t} as step, sqrt(sum(dist)) / count(*) as err from a{t}" for t in range(0, KMEANS_STEPS + 1))
    return (_km_final() + f",\nerrs as ({errs})\n"
            "select cast(s as integer) as steps, round(err, 6) as error from stop join errs on errs.step = stop.s")


def _with_center() -> str:
    return _km_ctes(0) + "\nselect p.id, p.f, c.center as g from pts p join a0 using (id) join c0 c on c.cid = a0.cid"


# edge lines with short and unreadable fields, and why a line is rejected
_VECTORS = ("select *, case when vec_id % 7 = 0 or label is null then 'short' "
            "when vec_id % 11 = 3 then 'unreadable' end as problem from embeddings")
_MIXED = ("select l_orderkey as src, l_partkey as dst, case when l_linenumber = 7 then 'short' "
          "when l_quantity > 45 then 'unreadable' end as problem from lineitem")


SQL: dict[str, str] = {
    # scans and sinks: the Spark side writes E1 out and reads it back
    "scan_edges_text": E1_TEXT,
    "scan_edges_csv": E1,
    "scan_edges_csv_header": E1,
    "scan_skip_header": E1,
    "scan_skip_lines": E1,
    "scan_rejects": (f"select count(*) as n_rows, count(*) filter (problem = 'short') as n_short, "
                     f"count(*) filter (problem = 'unreadable') as n_unreadable from ({_MIXED})"),
    "scan_drop_bad": f"select src, dst from ({_MIXED}) where problem is null",
    "sink_roundtrip": E1,
    "partition_profile": (f"select cast(src % 16 as integer) as partition, count(*) as n_rows from ({E1}) "
                          f"group by src % 16"),
    "scan_vectors_csv": (f"select cast(embedding[1] as double) as f0, cast(embedding[2] as double) as f1, cast(embedding[3] as double) as f2, "
                         f"cast(embedding[4] as double) as f3, cast(label as varchar) as label from ({_VECTORS}) where problem is null"),
    "scan_vector_rejects": (f"select count(*) as n_rows, count(*) filter (problem = 'short') as n_short, "
                            f"count(*) filter (problem = 'unreadable') as n_unreadable from ({_VECTORS})"),
    "scan_vectors": ("select vec_id as id, cast(i - 1 as integer) as dim, cast(embedding[i] as double) as value, "
                     "cast(label as varchar) as label from embeddings, generate_series(1, len(embedding)) g(i)"),
    "row_index": f"select src, dst, row_number() over (order by src, dst) - 1 as idx from ({E1})",
    "head_edges": f"select src, dst from ({E1}) order by src, dst limit 5",
    # pair operators
    "reverse_edges": f"select dst as src, src as dst from ({E1})",
    "mirror_explode": f"select src, dst from ({E1}) union all select dst, src from ({E1})",
    "mirror_union": f"select src, dst from ({E1}) union all select dst, src from ({E1})",
    "mirror_distinct": f"select src, dst from ({E1}) union select dst, src from ({E1})",
    "having_min_lt_key": f"select n1, min(n2) as mn from ({_mirror('e1')}) group by n1 having min(n2) < n1",
    "relabel_case": (f"select case when n2 = mn then n1 else n2 end as n1, mn as n2 "
                     f"from ({_with_min()}) where mn < n1"),
    "relabel_ordered": (f"select case when mn < n2 then n2 else n1 end as n1, mn as n2 "
                        f"from ({_with_min()}) where mn < n1"),
    "sql_function_relabel": (f"select case when n2 = mn then n1 else n2 end as n1, mn as n2 "
                             f"from ({_with_min()}) where mn < n1"),
    "sql_function_relabel_text": (f"select case when n2 = mn then n1 else n2 end as n1, mn as n2 "
                                  f"from ({_with_min('e1_text')}) where mn < n1"),
    "explode_neighbors": _mirror("e1"),
    "sorted_edges": f"select src, dst from ({E1}) order by src, dst",
    "id_cast_order": (f"select src, dst, src < dst as numeric_lt, "
                      f"cast(src as varchar) < cast(dst as varchar) as lexical_lt from ({E1})"),
    # joins
    "edges_join_min": f"select n1, n2, mn from ({_with_min()}) where mn < n1",
    "cogroup_lists": (f"with e as ({_pairs('e1')}), "
                      f"o as ({_list('n1', 'n2', 'select n1, n2 from e', 'out_nbrs')}), "
                      f"i as ({_list('n1', 'n2', 'select n2 as n1, n1 as n2 from e', 'in_nbrs')}) "
                      f"select coalesce(o.n1, i.n1) as node, coalesce(o.chunk, i.chunk) as chunk, "
                      f"o.out_nbrs, i.in_nbrs from o full outer join i on o.n1 = i.n1 and o.chunk = i.chunk"),
    # aggregations and windows
    "neighbor_min": f"select n1, min(n2) as mn from ({_mirror('e1')}) group by n1",
    "neighbor_set": _list("n1", "n2", _mirror("e1"), "nbrs"),
    "neighbor_sorted": _list("n1", "n2", _mirror("e1"), "nbrs"),
    "neighbor_list": _list("n1", "n2", f"select n1, n2 from ({_pairs('e1')}) union all "
                                       f"select n2, n1 from ({_pairs('e1')})", "nbrs"),
    "array_min_key": f"select n1, least(n1, min(n2)) as mn from ({_mirror('e1')}) group by n1",
    "dedup_pairs": f"select distinct src, dst from ({E1})",
    "distinct_nodes": f"select src as node from ({E1}) union select dst from ({E1})",
    "edge_count": f"select count(*) as n_edges from ({E1})",
    "new_pair_count": (f"select cast(coalesce(sum(k - 1), 0) as bigint) as new_pairs from "
                       f"(select n1, count(*) as k from ({_mirror('e1')}) group by n1 having min(n2) < n1)"),
    "group_first_value": f"select n1, n2, min(n2) over (partition by n1) as head from ({_mirror('e1')})",
    "secondary_sort_rank": (f"select n1, n2, row_number() over (partition by n1 order by n2) as rnk "
                            f"from ({_mirror('e1')})"),
    # components
    "cc_round_join": _rounds("e1", 1) + "\nselect n1, n2 from g1",
    "cc_round_collect": _rounds("e1", 1) + "\nselect n1, n2 from g1",
    "cc_round_sorted": _rounds("e1", 1) + "\nselect n1, n2 from g1",
    "cc_round_window": _rounds("e1", 1) + "\nselect n1, n2 from g1",
    "connected_components": _membership("e1"),
    "connected_components_e2": _membership("e2"),
    "connected_components_e3": _membership("e3"),
    "connected_components_contract": _membership("e1"),
    "connected_components_contract_e3": _membership("e3"),
    "components_lexical": _membership("e1_text"),
    "cc_trace": _trace("e2"),
    "cc_trace_e1": _trace("e1"),
    "cc_trace_e3": _trace("e3"),
    "cc_rounds_4": _rounds("e2", 4) + "\nselect n1, n2 from g4",
    "cc_states_4": _rounds("e2", 4) + "\n" + " union all ".join(
        f"select {i} as round, n1, n2 from g{i}" for i in range(1, 5)),
    "cc_new_pairs_distinct": (f"with s as ({_mirror('e2')}), m as (select n1, min(n2) as mn from s group by n1 "
                              f"having min(n2) < n1) select distinct s.n2 as n1, m.mn as n2 from s join m using (n1) "
                              f"where s.n2 <> m.mn"),
    "cc_new_pairs": (f"with s as ({_mirror('e2')}), m as (select n1, min(n2) as mn from s group by n1 "
                     f"having min(n2) < n1) select s.n2 as n1, m.mn as n2 from s join m using (n1) "
                     f"where s.n2 <> m.mn"),
    "component_count": f"select count(distinct component) as n_components from ({_membership('e1')})",
    "nonroot_count": f"select count(*) as n_nonroot from ({_membership('e1')})",
    "component_nonroot_counts": (f"select component, count(*) as n_nonroot from ({_membership('e1')}) "
                                 f"group by component order by n_nonroot desc, component"),
    "component_sizes": (f"select component, count(*) + 1 as n_nodes from ({_membership('e1')}) "
                        f"group by component"),
    "component_members": (f"with m as ({_membership('e2')}), "
                          f"w as (select node, component from m union select component, component from m) "
                          + _list("component", "node", "select component, node from w", "members")),
    "component_members_lexical": (f"with m as ({_reach(E3_TEXT)}), "
                                  f"w as (select node, component from m union select component, component from m) "
                                  + _list("component", "node", "select component, node from w", "members")),
    "top_components": (f"select component, count(*) + 1 as n_nodes from ({_membership('e3')}) "
                       f"group by component order by n_nodes desc, component limit 20"),
    # k-means and vectors
    "sample_k": f"select vec_id as id from embeddings order by {_SAMPLE_ORDER.format(id='vec_id')} limit 3",
    "kmeans_init_sample": (
        f"with s as (select vec_id as id, cast(embedding as double[]) as f from embeddings "
        f"order by {_SAMPLE_ORDER.format(id='vec_id')} limit 3), "
        f"c as (select row_number() over (order by {_SAMPLE_ORDER.format(id='id')}) - 1 as cid, "
        f"f as center from s)\n" + _km_long("select cid, center from c")),
    "kmeans_init": _km_ctes(0) + "\n" + _km_long("select cid, center from c0"),
    "kmeans_assign": _km_ctes(0) + "\nselect id, cid, round(dist, 6) as dist from a0",
    "kmeans_assign_points": (_km_ctes(0) + "\nselect p.id, a0.cid, cast(i - 1 as integer) as dim, p.f[i] as value, p.label "
                             "from pts p join a0 using (id), generate_series(1, len(p.f)) s(i)"),
    "nearest_centroid": _km_ctes(0) + "\nselect id, cid from a0",
    "cross_distance": (_km_ctes(0) + "\nselect p.id, c.cid, round(list_distance(p.f, c.center), 6) as dist "
                       "from pts p, c0 c"),
    "cluster_counts": _km_ctes(0) + "\nselect cid, count(*) as n from a0 group by cid",
    "cluster_vector_sum": (_km_ctes(0) + "\nselect cast(a.cid as integer) as cid, cast(i - 1 as integer) as dim, "
                           "round(sum(p.f[i]), 6) as total from a0 a join pts p using (id), "
                           "generate_series(1, len(p.f)) g(i) group by a.cid, i"),
    "kmeans_update": _km_ctes(1) + "\n" + _km_long("select cid, center from c1"),
    "kmeans_switches": (_km_ctes(1) + "\nselect count(*) as switches from a1 x join a0 y using (id) "
                        "where x.cid <> y.cid"),
    "kmeans_error": _km_ctes(0) + "\nselect round(sqrt(sum(dist)) / count(*), 6) as error from a0",
    "kmeans": _kmeans_final_assignment(),
    "kmeans_steps": _kmeans_steps(),
    "vector_distance": f"select id, round(list_distance(f, g), 6) as dist from ({_with_center()})",
    "vector_add": (f"select id, cast(i - 1 as integer) as dim, round(f[i] + g[i], 6) as value "
                   f"from ({_with_center()}) x, generate_series(1, len(f)) s(i)"),
    "vector_scale": (f"select id, cast(i - 1 as integer) as dim, "
                     f"round(f[i] / (cast(label as double) + 1), 6) as value "
                     f"from ({PTS}) x, generate_series(1, len(f)) s(i)"),
}
