"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or what Spark derives from them) in full. Graph
queries use the edge tables of ``sources.edges`` (E1: every line item's order--part, E2: every event's
user--property, E3: duplicate documents); k-means queries use the embedding vectors with the first
three ids as initial centroids. Vectors and lists are returned in long form
(``(id, dim, value)`` rows, comma-joined id lists) so results compare as plain values.
Scratch tables that a lazy result reads belong to the caller's ``storage.scratch`` block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.functions.ids import as_string_ids
from linkfold.functions.sql import register_relabel
from linkfold.functions.vectors import centers_literal, euclidean_distance, vector_add, vector_scale
from linkfold.operators import kmeans as km
from linkfold.operators.components import connected_components, iterate
from linkfold.operators.keyed import attach_group_min, key_stats
from linkfold.operators.ordering import chunked_lists, partition_profile, rank_in_group, row_index, sorted_sets
from linkfold.operators.pairs import (as_pairs, dedup_pairs, distinct_nodes, mirror_distinct,
                                      mirror_explode, mirror_union, relabel_case,
                                      relabel_ordered, reverse_pairs)
from linkfold.operators.reports import (MEMBER_CHUNK, component_count, component_members,
                                        component_sizes, nonroot_count, nonroot_counts,
                                        top_components)
from linkfold.operators.rounds import cc_round
from linkfold.sources.edges import (GRAPHS, edge_report, embedding_vectors, read_edges_csv,
                                    read_edges_text, read_vectors_csv, table, vector_report, write_edges_text)
from linkfold.sources.sinks import read_result, write_result
from linkfold.storage import new_scratch_path

Query = Callable[[SparkSession, str], DataFrame]
KMEANS_INIT_IDS = [0, 1, 2]   # "start from vec_id < 3", k = 3
LEAD_FILE_EDGES = 200_000     # edges of a file with lead lines
VALUE_DIGITS = 6              # doubles are compared rounded to this many places


def edges(spark, sf, g="e1") -> DataFrame:
    return GRAPHS[g](spark, sf)


def mirrored(spark, sf, g="e1") -> DataFrame:
    return mirror_distinct(as_pairs(edges(spark, sf, g)))


def membership(spark, sf, g="e1", strategy="contract") -> DataFrame:
    """Reports need no trace, so the edges are contracted: star rounds would make up to three times as many pairs of E1 first."""
    return connected_components(edges(spark, sf, g), strategy=strategy).membership()


def _r(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, VALUE_DIGITS).alias(name or c)


def _joined(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.array_join(F.transform(col, lambda x: x.cast("string")), ","))


def _chunked_list(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``(key, chunk, out)``: sorted values per key, at most MEMBER_CHUNK to a row, comma-joined."""
    return _joined(chunked_lists(df, key, value, out, MEMBER_CHUNK), out)


# ----------------------------------------------------------------- scans and sinks

def q_scan_edges_text(spark, sf):
    path = new_scratch_path(spark, "scan-text")
    write_edges_text(edges(spark, sf), path, sep="\t")
    return read_edges_text(spark, f"{path}/edges", sep="\t", id_type="string")


def q_scan_edges_csv(spark, sf):
    path = new_scratch_path(spark, "scan-csv")
    write_edges_text(edges(spark, sf), path, sep=",")
    return read_edges_csv(spark, f"{path}/edges", sep=",", id_type="long")


def q_scan_edges_csv_header(spark, sf):
    path = new_scratch_path(spark, "scan-csvh")
    write_edges_text(edges(spark, sf), path, sep=",", header=True)
    return read_edges_csv(spark, f"{path}/edges", header=True, id_type="long")


def q_scan_skip_header(spark, sf):
    path = new_scratch_path(spark, "scan-skip")
    preamble = ["# Undirected graph: order -- part", "# Nodes and edges from lineitem",
                "# FromNodeId\tToNodeId", "#"]
    write_edges_text(edges(spark, sf), path, sep="\t", preamble=preamble)
    return read_edges_csv(spark, [f"{path}/preamble", f"{path}/edges"], sep="\t",
                          id_type="long", comment="#")


def q_scan_skip_lines(spark, sf):
    """Four lead lines without any mark in front of every file's edges, skipped by their number."""
    path = new_scratch_path(spark, "scan-lead")
    lead = [F.lit(x) for x in ("Undirected graph", "Nodes and edges", "From\tTo", "17\t4")]
    # every LEAD_FILE_EDGES edges of a scan task begin a file, its lead lines first: tasks write as they read, nothing is sorted
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % LEAD_FILE_EDGES
    lines = edges(spark, sf).select(F.concat_ws("\t", "src", "dst").alias("value"), at.alias("at"))
    (lines.select(F.explode(F.when(F.col("at") == 0, F.array(*lead, "value")).otherwise(F.array("value"))).alias("value"))
     .write.option("maxRecordsPerFile", LEAD_FILE_EDGES + len(lead)).text(path))
    return read_edges_csv(spark, path, sep="\t", id_type="long", skip_lines=4)


def _mixed_lines(spark, sf) -> str:
    """Edge lines of which some are short and some hold a word where the part's id should be."""
    path = new_scratch_path(spark, "scan-mixed")
    li = table(spark, sf, "lineitem")
    part = F.when(F.col("l_linenumber") == 7, F.lit("")).when(F.col("l_quantity") > 45, F.lit("n/a")) \
        .otherwise(F.col("l_partkey").cast("string"))
    li.select(F.concat_ws(",", F.col("l_orderkey"), part).alias("value")).write.text(path)
    return path


def q_scan_rejects(spark, sf):
    return edge_report(spark, _mixed_lines(spark, sf))


def q_scan_drop_bad(spark, sf):
    return read_edges_csv(spark, _mixed_lines(spark, sf), on_bad="drop")


def _vector_lines(spark, sf):
    """A vector file of ``embeddings``: four features and the label a line; some lines without a label, some with a feature that is no number."""
    e = table(spark, sf, "embeddings")
    fields = [F.col("embedding")[i].cast("double").cast("string") for i in range(4)]
    fields[1] = F.when(F.col("vec_id") % 11 == 3, F.lit("n/a")).otherwise(fields[1])
    label = F.when(F.col("vec_id") % 7 != 0, F.col("label").cast("string"))
    path = new_scratch_path(spark, "vector-lines")
    e.select(F.concat_ws(",", *fields, label).alias("value")).write.text(path)
    return path


def q_scan_vectors_csv(spark, sf):
    v = read_vectors_csv(spark, _vector_lines(spark, sf), on_bad="drop")
    return v.select(*[F.col("features")[i].alias(f"f{i}") for i in range(4)], "label")


def q_scan_vector_rejects(spark, sf):
    return vector_report(spark, _vector_lines(spark, sf))


def q_sink_roundtrip(spark, sf):
    path = new_scratch_path(spark, "sink")
    write_result(edges(spark, sf), path, fmt="parquet")
    return read_result(spark, path)


def q_scan_vectors(spark, sf):
    v = embedding_vectors(spark, sf)
    return v.select("id", F.posexplode("features").alias("dim", "value"), "label")


def q_row_index(spark, sf):
    return row_index(edges(spark, sf), ["src", "dst"], "idx")


def q_head_edges(spark, sf):
    return edges(spark, sf).orderBy("src", "dst").limit(5)


def q_partition_profile(spark, sf):
    return partition_profile(edges(spark, sf), "src", 16)


# ----------------------------------------------------------------- pair operators

def q_reverse_edges(spark, sf):
    return reverse_pairs(edges(spark, sf), "src", "dst")


def q_mirror_union(spark, sf):
    return mirror_union(edges(spark, sf), "src", "dst")


def q_mirror_explode(spark, sf):
    return mirror_explode(edges(spark, sf), "src", "dst")


def q_mirror_distinct(spark, sf):
    return mirror_distinct(edges(spark, sf), "src", "dst")


def q_dedup_pairs(spark, sf):
    return dedup_pairs(edges(spark, sf))


def q_distinct_nodes(spark, sf):
    return distinct_nodes(edges(spark, sf), "src", "dst")


def q_edge_count(spark, sf):
    return edges(spark, sf).agg(F.count(F.lit(1)).alias("n_edges"))


def q_sorted_edges(spark, sf):
    return edges(spark, sf).orderBy("src", "dst")


def q_neighbor_min(spark, sf):
    return key_stats(mirrored(spark, sf)).select("n1", "mn")


def q_having_min_lt_key(spark, sf):
    return key_stats(mirrored(spark, sf)).where(F.col("mn") < F.col("n1")).select("n1", "mn")


def q_neighbor_set(spark, sf):
    return _chunked_list(mirrored(spark, sf), "n1", "n2", "nbrs")


def q_neighbor_sorted(spark, sf):
    """Sorted sets from the bag of both directions: one sort orders the values and finds the repeats."""
    return _joined(sorted_sets(mirror_union(as_pairs(edges(spark, sf))), "n1", "n2", "nbrs", MEMBER_CHUNK), "nbrs")


def q_neighbor_list(spark, sf):
    return _chunked_list(mirror_union(as_pairs(edges(spark, sf))), "n1", "n2", "nbrs")


def _neighbor_lists(spark, sf):
    return chunked_lists(mirrored(spark, sf), "n1", "n2", "nbrs", MEMBER_CHUNK)


def q_array_min_key(spark, sf):
    return (_neighbor_lists(spark, sf).groupBy("n1")
            .agg(F.least(F.col("n1"), F.min(F.array_min("nbrs"))).alias("mn")))


def q_explode_neighbors(spark, sf):
    return _neighbor_lists(spark, sf).select("n1", F.explode("nbrs").alias("n2"))


def _with_min(spark, sf, cold="join", g="e1"):
    # the mirrored set has at most twice the source edges: a scan, not the distinct, sizes it
    bound = 2 * edges(spark, sf, g).count()
    return attach_group_min(mirrored(spark, sf, g), "n1", "n2", "mn", cold=cold, n_rows_bound=bound)


def q_relabel_case(spark, sf):
    m = _with_min(spark, sf).where(F.col("mn") < F.col("n1"))
    return m.select(relabel_case(F.col("n1"), F.col("mn"), F.col("n2")).alias("n1"),
                    F.col("mn").alias("n2"))


def q_relabel_ordered(spark, sf):
    m = _with_min(spark, sf).where(F.col("mn") < F.col("n1"))
    return m.select(relabel_ordered(F.col("n1"), F.col("mn"), F.col("n2")).alias("n1"),
                    F.col("mn").alias("n2"))


def _relabelled_by_function(m: DataFrame) -> DataFrame:
    fn = register_relabel(m, "n1")
    return m.sparkSession.sql(f"SELECT {fn}(n1, mn, n2) AS n1, mn AS n2 FROM {{m}} WHERE mn < n1", m=m)


def q_sql_function_relabel(spark, sf):
    return _relabelled_by_function(_with_min(spark, sf))


def q_sql_function_relabel_text(spark, sf):
    """The same function over string ids; both live in one session."""
    e = as_string_ids(edges(spark, sf))
    m = attach_group_min(mirror_distinct(as_pairs(e)), "n1", "n2", "mn", cold="join", n_rows_bound=2 * e.count())
    return _relabelled_by_function(m)


def q_edges_join_min(spark, sf):
    return _with_min(spark, sf, "join").where(F.col("mn") < F.col("n1")).select("n1", "n2", "mn")


def q_group_first_value(spark, sf):
    return _with_min(spark, sf, "window").select("n1", "n2", F.col("mn").alias("head"))


def q_secondary_sort_rank(spark, sf):
    ranked = rank_in_group(mirrored(spark, sf), "n1", "n2", "rnk")
    return ranked.select("n1", "n2", (F.col("rnk") + 1).alias("rnk"))


def q_cogroup_lists(spark, sf):
    e = as_pairs(edges(spark, sf))
    outs = _chunked_list(e, "n1", "n2", "out_nbrs").withColumnRenamed("n1", "node")
    ins = _chunked_list(e.select(F.col("n2").alias("n1"), F.col("n1").alias("n2")),
                        "n1", "n2", "in_nbrs").withColumnRenamed("n1", "node")
    return outs.join(ins, ["node", "chunk"], "full_outer")


def q_id_cast_order(spark, sf):
    e = as_string_ids(edges(spark, sf))
    return e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"),
                    (F.col("src").cast("long") < F.col("dst").cast("long")).alias("numeric_lt"),
                    (F.col("src") < F.col("dst")).alias("lexical_lt"))


# ----------------------------------------------------------------- components

def _cc(g, strategy="join"):
    return lambda spark, sf: membership(spark, sf, g, strategy)


def _trace(g):
    def q(spark, sf):
        return connected_components(edges(spark, sf, g), strategy="grouped").trace_df(spark)
    return q


def _round(strategy):
    def q(spark, sf):
        return cc_round(as_pairs(edges(spark, sf)), strategy, first_round=True)
    return q


def q_components_lexical(spark, sf):
    res = connected_components(as_string_ids(edges(spark, sf)), strategy="contract")
    return res.membership()


def q_component_sizes(spark, sf):
    return component_sizes(membership(spark, sf))


def q_component_nonroot_counts(spark, sf):
    return nonroot_counts(membership(spark, sf))


def q_top_components(spark, sf):
    return top_components(membership(spark, sf, "e3"), 20)


def q_component_members(spark, sf):
    return component_members(membership(spark, sf, "e2"))


def q_component_members_lexical(spark, sf):
    return component_members(connected_components(as_string_ids(edges(spark, sf, "e3"))).membership())


def q_component_count(spark, sf):
    return component_count(membership(spark, sf))


def q_nonroot_count(spark, sf):
    return nonroot_count(membership(spark, sf))


def q_cc_rounds_4(spark, sf):
    return iterate(as_pairs(edges(spark, sf, "e2")), rounds=4).pairs


def q_cc_states_4(spark, sf):
    return iterate(as_pairs(edges(spark, sf, "e2")), rounds=4, keep_states=True).states


def q_cc_new_pairs_distinct(spark, sf):
    return q_cc_new_pairs(spark, sf).distinct()


def q_cc_new_pairs(spark, sf):
    m = _with_min(spark, sf, "join", "e2")
    return (m.where((F.col("mn") < F.col("n1")) & (F.col("n2") != F.col("mn")))
            .select(F.col("n2").alias("n1"), F.col("mn").alias("n2")))


def q_new_pair_count(spark, sf):
    st = key_stats(mirrored(spark, sf))
    return st.agg(F.coalesce(F.sum(F.when(F.col("mn") < F.col("n1"), F.col("deg") - 1)),
                             F.lit(0)).cast("long").alias("new_pairs"))


# ----------------------------------------------------------------- k-means and vectors

def _points(spark, sf):
    return embedding_vectors(spark, sf)


def _c0(spark, sf):
    return km.collect_centers(km.init_by_ids(_points(spark, sf), KMEANS_INIT_IDS))


def _long_centers(df: DataFrame, col: str = "center") -> DataFrame:
    return df.select(F.col("cid").cast("int").alias("cid"),
                     F.posexplode(col).alias("dim", "value")).select("cid", "dim", _r("value"))


def q_kmeans_init(spark, sf):
    return _long_centers(km.init_by_ids(_points(spark, sf), KMEANS_INIT_IDS))


def q_kmeans_init_sample(spark, sf):
    return _long_centers(km.init_by_sample(_points(spark, sf), 3))


def q_kmeans_assign(spark, sf):
    a = km.assign(_points(spark, sf), _c0(spark, sf))
    return a.select("id", F.col("cid").cast("int").alias("cid"), _r("dist"))


def q_kmeans_assign_points(spark, sf):
    a = km.assign(_points(spark, sf), _c0(spark, sf))
    return a.select("id", F.col("cid").cast("int").alias("cid"), F.posexplode("features").alias("dim", "value"), "label")


def q_nearest_centroid(spark, sf):
    a = km.assign(_points(spark, sf), _c0(spark, sf))
    return a.select("id", F.col("cid").cast("int").alias("cid"))


def q_cross_distance(spark, sf):
    d = km.point_distances(_points(spark, sf), _c0(spark, sf))
    return d.select("id", F.col("cid").cast("int").alias("cid"), _r("dist"))


def q_cluster_counts(spark, sf):
    a = km.assign(_points(spark, sf), _c0(spark, sf))
    return a.groupBy(F.col("cid").cast("int").alias("cid")).agg(F.count(F.lit(1)).alias("n"))


def q_cluster_vector_sum(spark, sf):
    c0 = _c0(spark, sf)
    agg = km.cluster_aggregates(km.assign(_points(spark, sf), c0))
    return _long_centers(agg, "sums").withColumnRenamed("value", "total")


def q_kmeans_update(spark, sf):
    c0 = _c0(spark, sf)
    return _long_centers(km.update(km.assign(_points(spark, sf), c0)))


def q_kmeans_switches(spark, sf):
    pts, c0 = _points(spark, sf), _c0(spark, sf)
    c1 = km.collect_centers(km.update(km.assign(pts, c0)))
    return km.switches(pts, c0, c1)


def q_kmeans_error(spark, sf):
    e = km.error(km.assign(_points(spark, sf), _c0(spark, sf)))
    return e.select(_r("error"))


def q_kmeans(spark, sf):
    res = km.kmeans(_points(spark, sf), _c0(spark, sf))
    return res.assignment.select("id", F.col("cid").cast("int").alias("cid"), _r("dist"))


def q_kmeans_steps(spark, sf):
    res = km.kmeans(_points(spark, sf), _c0(spark, sf))
    return spark.createDataFrame([(res.steps, res.error)], "steps int, error double") \
        .select("steps", _r("error"))


def q_sample_k(spark, sf):
    return km.sample_k(_points(spark, sf), 3).select("id")


def _with_center(spark, sf):
    """Every point next to its nearest initial centroid ``g``."""
    c0 = _c0(spark, sf)
    return km.assign(_points(spark, sf), c0).withColumn("g", F.element_at(
        F.map_from_entries(F.transform(centers_literal(c0), lambda c: F.struct(c["cid"], c["center"]))), F.col("cid")))


def q_vector_distance(spark, sf):
    return _with_center(spark, sf).select("id", _r(euclidean_distance("features", "g"), "dist"))


def _long_vec(df, col):
    return (df.select("id", F.posexplode(col).alias("dim", "value")).select("id", "dim", _r("value")))


def q_vector_add(spark, sf):
    return _long_vec(_with_center(spark, sf).select("id", vector_add("features", "g").alias("v")), "v")


def q_vector_scale(spark, sf):
    p = _points(spark, sf)
    return _long_vec(p.select("id", vector_scale("features", F.col("label").cast("double") + 1)
                              .alias("v")), "v")


QUERIES: dict[str, Query] = {
    # scans, sources, sinks
    "scan_edges_text": q_scan_edges_text,
    "scan_edges_csv": q_scan_edges_csv,
    "scan_edges_csv_header": q_scan_edges_csv_header,
    "scan_skip_header": q_scan_skip_header,
    "scan_skip_lines": q_scan_skip_lines,
    "scan_rejects": q_scan_rejects,
    "scan_drop_bad": q_scan_drop_bad,
    "scan_vectors": q_scan_vectors,
    "scan_vectors_csv": q_scan_vectors_csv,
    "scan_vector_rejects": q_scan_vector_rejects,
    "row_index": q_row_index,
    "sink_roundtrip": q_sink_roundtrip,
    "head_edges": q_head_edges,
    "partition_profile": q_partition_profile,
    # projections, filters, set operations, sorts
    "reverse_edges": q_reverse_edges,
    "mirror_explode": q_mirror_explode,
    "mirror_union": q_mirror_union,
    "mirror_distinct": q_mirror_distinct,
    "having_min_lt_key": q_having_min_lt_key,
    "relabel_case": q_relabel_case,
    "relabel_ordered": q_relabel_ordered,
    "sql_function_relabel": q_sql_function_relabel,
    "sql_function_relabel_text": q_sql_function_relabel_text,
    "explode_neighbors": q_explode_neighbors,
    "sorted_edges": q_sorted_edges,
    "id_cast_order": q_id_cast_order,
    # joins
    "edges_join_min": q_edges_join_min,
    "cogroup_lists": q_cogroup_lists,
    "cross_distance": q_cross_distance,
    # aggregations and windows
    "neighbor_min": q_neighbor_min,
    "neighbor_set": q_neighbor_set,
    "neighbor_sorted": q_neighbor_sorted,
    "neighbor_list": q_neighbor_list,
    "array_min_key": q_array_min_key,
    "dedup_pairs": q_dedup_pairs,
    "distinct_nodes": q_distinct_nodes,
    "edge_count": q_edge_count,
    "new_pair_count": q_new_pair_count,
    "group_first_value": q_group_first_value,
    "secondary_sort_rank": q_secondary_sort_rank,
    # components
    "cc_round_join": _round("join"),
    "cc_round_collect": _round("collect"),
    "cc_round_sorted": _round("sorted"),
    "cc_round_window": _round("window"),
    "connected_components": _cc("e1", "contract"),
    "connected_components_e2": _cc("e2"),
    "connected_components_e3": _cc("e3"),
    "connected_components_contract": _cc("e1", "contract"),
    "connected_components_contract_e3": _cc("e3", "contract"),
    "components_lexical": q_components_lexical,
    "cc_trace": _trace("e2"),
    "cc_trace_e1": _trace("e1"),
    "cc_trace_e3": _trace("e3"),
    "cc_rounds_4": q_cc_rounds_4,
    "cc_states_4": q_cc_states_4,
    "cc_new_pairs": q_cc_new_pairs,
    "cc_new_pairs_distinct": q_cc_new_pairs_distinct,
    "component_count": q_component_count,
    "nonroot_count": q_nonroot_count,
    "component_nonroot_counts": q_component_nonroot_counts,
    "component_sizes": q_component_sizes,
    "component_members": q_component_members,
    "component_members_lexical": q_component_members_lexical,
    "top_components": q_top_components,
    # k-means and vectors
    "kmeans_init": q_kmeans_init,
    "kmeans_init_sample": q_kmeans_init_sample,
    "kmeans_assign": q_kmeans_assign,
    "kmeans_assign_points": q_kmeans_assign_points,
    "nearest_centroid": q_nearest_centroid,
    "cluster_counts": q_cluster_counts,
    "cluster_vector_sum": q_cluster_vector_sum,
    "kmeans_update": q_kmeans_update,
    "kmeans_switches": q_kmeans_switches,
    "kmeans_error": q_kmeans_error,
    "kmeans": q_kmeans,
    "kmeans_steps": q_kmeans_steps,
    "sample_k": q_sample_k,
    "vector_distance": q_vector_distance,
    "vector_add": q_vector_add,
    "vector_scale": q_vector_scale,
}
