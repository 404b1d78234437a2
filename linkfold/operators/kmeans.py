"""Step-wise k-means (Lloyd) over ``(id, features array<double>, label)`` rows.

Physical plan: centroids are ``k`` rows (a parameter, not data), so they travel as a
literal inside the expression and every point picks its nearest one map-side: no join,
no cross product, no shuffle of the points. One step is one aggregation job:

    assign -> groupBy(cid): count, sum(dist), switches, one array-valued vector sum (partial aggregation, so a
        cluster holding most points is no hotter than any other) -> k rows to the driver.

Distance bounds. Most points stay where they are, so a step does not compare them with every centroid. An *anchor* holds
for each point its cluster ``c0``, the distance ``d0`` to it and the distance ``l0`` to the second
nearest centroid, all under the centroids of one step. Later centroids have moved by known distances, so by the triangle inequality
no other centroid is nearer than ``l0`` less the greatest move; a point whose own centroid is surely nearer needs that one
distance and no more. Where the bounds cross, all ``k`` are computed. The anchor is renewed once the evaluations that
its age has cost would have paid for a new one. It is a cached table made from the points and two sets of centroids, so a lost block is
recomputed from the source, and its plan does not grow with the steps.

The anchor and the steps run over Arrow batches with numpy (``_anchor_batches``, ``_step_batches``): a distance in SQL is a lambda evaluated for every
element of every vector. A task sends one row per cluster and part on. ``_anchor_sql`` and ``_step_sql`` say the same in SQL; a test compares the two.

Semantics kept from the analysed script: stop when no point switched cluster or after
``max_steps`` steps; empty clusters disappear; error is ``sqrt(sum(dist)) / n``
(not a mean squared error). Fixed here: the first step's switch count is ``n`` (not a
hard-coded 150), the initial centroids are distinct and deterministic, distance ties go
to the lowest cluster id, and centroids are rounded to ``digits`` places every step so
the result does not depend on summation order.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.functions.vectors import distance_sql, distances_to, nearest, nearest_sql, ranked_sql
from linkfold.operators.sampling import least_by_hash

Centers = list[tuple[int, list[float]]]


def init_by_ids(points: DataFrame, ids: list[int]) -> DataFrame:
    """K1 with given ids: centroid ``i`` is the point with the ``i``-th smallest id. Raises if an id has no point."""
    chosen = points.where(F.col("id").isin(ids)).select("id", "features")
    missing = set(ids) - {r["id"] for r in chosen.select("id").distinct().collect()}   # at most len(ids) rows
    if missing:
        raise ValueError(f"no point has id {sorted(missing)}")
    # at most len(ids) rows: a window over them is bounded by the parameter
    return chosen.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cid"),
                         F.col("features").alias("center"))


# Fixed values of the seeded sample order: a multiplicative congruential hash of the id,
# computed with 64-bit integer arithmetic that every SQL engine evaluates alike.
SAMPLE_MULTIPLIER = 1103515245
SAMPLE_MODULUS = 2147483648   # 2^31


def sample_order(id_col: str = "id", seed: int = 42):
    """``((id mod 2^31) * 1103515245 + seed) mod 2^31``: a seeded pseudo-random order of
    the ids (a bijection on ids below 2^31; ties beyond that are broken by the id)."""
    m = F.lit(SAMPLE_MODULUS)
    return F.pmod(F.pmod(F.col(id_col), m) * SAMPLE_MULTIPLIER + F.lit(seed), m)


def sample_k(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """O6: ``k`` distinct rows in a seeded hash order, cut by a bound on the hash (``sampling``): about ``k`` rows leave the tasks."""
    return least_by_hash(points, sample_order("id", seed), k, 0, SAMPLE_MODULUS - 1, ["id"])


def init_by_sample(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    s = sample_k(points, k, seed)
    # at most k rows: a window over them is bounded by the parameter
    return s.select((F.row_number().over(Window.orderBy(sample_order("id", seed), "id")) - 1)
                    .alias("cid"), F.col("features").alias("center"))


def collect_centers(centers: DataFrame) -> Centers:
    """The ``k`` centroid rows on the driver (bounded by ``k``)."""
    return sorted((int(r["cid"]), [float(v) for v in r["center"]]) for r in centers.collect())


def assign(points: DataFrame, centers: Centers) -> DataFrame:
    """K2: ``(id, cid, dist, features, label)`` under ``centers``."""
    best = nearest("features", centers)
    return points.select("id", best["cid"].alias("cid"), best["dist"].alias("dist"),
                         "features", "label")


def point_distances(points: DataFrame, centers: Centers) -> DataFrame:
    """J3 without a cross join: ``(id, cid, dist)`` for each point and each centroid."""
    return (points.select("id", F.explode(distances_to("features", centers)).alias("d"))
            .select("id", F.col("d.cid").alias("cid"), F.col("d.dist").alias("dist")))


def _dims(centers: Centers) -> int:
    return len(centers[0][1]) if centers else 0


def vector_sum(col: str) -> Column:
    """The sum of vectors as one aggregate, whatever their width."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(col))))


def cluster_aggregates(assigned: DataFrame) -> DataFrame:
    """``(cid, n, sum_dist, sums array<double>)``: one partial-aggregated pass."""
    return assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("sum_dist"),
                                       vector_sum("features").alias("sums"))


def update(assigned: DataFrame, digits: int = 9) -> DataFrame:
    """K3: ``(cid, center)`` = mean of the cluster's points, rounded to ``digits``."""
    agg = cluster_aggregates(assigned)
    return agg.select("cid", F.transform("sums", lambda s: F.round(s / F.col("n"), digits))
                      .alias("center"))


def switches(points: DataFrame, before: Centers, after: Centers) -> DataFrame:
    """K4: number of points whose nearest centroid differs between two centroid sets."""
    a, b = nearest("features", before), nearest("features", after)
    return points.agg(F.count(F.when(a["cid"] != b["cid"], 1)).alias("switches"))


def error(assigned: DataFrame) -> DataFrame:
    """K5: ``sqrt(sum(dist)) / n``."""
    return assigned.agg((F.sqrt(F.sum("dist")) / F.count(F.lit(1))).alias("error"))


@dataclass
class KMeansResult:
    assignment: DataFrame
    centers: Centers
    error: float
    steps: int
    converged: bool   # no point switched in the last step; False if max_steps ended the run
    trace: list[tuple[int, int, float]] = field(default_factory=list)  # (step, switches, sum_dist)
    evaluations: list[int] = field(default_factory=list)               # distances computed in each step


def kmeans(points: DataFrame, init: DataFrame | Centers, max_steps: int = 100,
           digits: int = 9) -> KMeansResult:
    """K6: Lloyd steps until no point switches cluster or ``max_steps`` is reached (the result says which).

    Steps read the anchor (see the module text), a cached table; ``points`` is read again where it is renewed.
    """
    cur = collect_centers(init) if isinstance(init, DataFrame) else sorted(init)
    return _loop(points, cur, _dims(cur), max_steps, digits)


def _anchor_sql(dims: int, digits: int, first: bool) -> str:
    """The anchor under ``:cur`` over ``{pts}``: ``features, c0, d0, l0`` and whether the point has left its cluster under ``:old``."""
    moved = "1" if first else f"CAST(({nearest_sql('features', dims, digits=digits, param='old')}).cid <> r[0].cid AS INT)"
    return (f"SELECT features, r[0].cid AS c0, r[0].dist AS d0, coalesce(get(r, 1).dist, double('Infinity')) AS l0, {moved} AS sw0 "
            f"FROM (SELECT features, {ranked_sql('features', dims, digits, 'cur')} AS r FROM {{pts}})")


def _step_sql(dims: int, digits: int) -> str:
    """One step over the anchor ``{pts}``. ``:cur`` and ``:old`` are the centroids of this step and the previous one (JSON), ``:now`` and ``:was``
    how they have moved since the anchor, by cluster, so the text is the same from step to step. ``crossed`` counts the comparisons with all
    centroids (0 to 2). The margin keeps rounded ties, which go to the lowest cid, out of what is sure."""
    moves = "map<string,struct<center:array<double>,drift:double,slack:double>>"
    margin = f"{4 * 10.0 ** -digits:.17f}D"
    cur, old = (nearest_sql("features", dims, digits=digits, param=p) for p in ("cur", "old"))
    own = distance_sql("features", "now.center")
    return (
        f"SELECT b.cid AS cid, b.dist AS dist, CAST(if(stayed, c0, ({old}).cid) <> b.cid AS INT) AS sw, "
        f"CAST(NOT sure AS INT) + CAST(NOT stayed AS INT) AS crossed, features FROM ("
        f"SELECT c0, features, sure, stayed, if(sure, named_struct('key', round(own, {digits}), 'cid', c0, 'dist', own), {cur}) AS b FROM ("
        f"SELECT c0, features, own, coalesce(own + {margin} < l0 - now.slack, false) AS sure, "
        f"coalesce(d0 + was.drift + {margin} < l0 - was.slack, false) AS stayed FROM ("
        f"SELECT *, {own} AS own FROM ("
        f"SELECT *, try_element_at(from_json(:now, '{moves}'), string(c0)) AS now, "
        f"try_element_at(from_json(:was, '{moves}'), string(c0)) AS was FROM {{pts}}))))")


def _moves(anchor: Centers, now: Centers) -> str:
    """For each cluster that is left: its centroid, how far it has moved since the anchor, and the farthest that another has."""
    at, here = dict(anchor), dict(now)
    drift = {c: math.dist(at[c], v) for c, v in here.items()}
    return json.dumps({str(c): {"center": v, "drift": drift[c], "slack": max((d for o, d in drift.items() if o != c), default=0.0)}
                       for c, v in here.items()})


ANCHOR_SCHEMA = "features binary, c0 long, d0 double, l0 double, sw0 long"   # features: the vector's doubles, one after the other
PART_SCHEMA = "cid long, n long, sum_dist double, sw long, crossed long, sums array<double>"
PIECE = 1 << 18   # elements of the vectors that numpy works on at once: 2 MB


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as a matrix; a vector of another size, or with a null element, ends the run."""
    sizes = column.value_lengths()
    if column.null_count or (np.asarray(sizes) != dims).any():
        odd = next(n for n in sizes.to_pylist() if n != dims)
        raise ValueError(f"a vector has {'no' if odd is None else odd} elements, not {dims}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has an element that is null")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Rows times centroids. Differences first: the difference of squares would lose the places that are compared."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        diff = x - c
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _least(dist: np.ndarray, digits: int) -> np.ndarray:
    """Index of the nearest centroid by rounded distance, the first of equals; NaN is the farthest."""
    key = np.round(dist, digits)
    return np.where(np.isnan(key), np.inf, key).argmin(axis=1)


def _pieces(n: int, dims: int) -> Iterator[slice]:
    step = max(1, PIECE // max(1, dims))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def _anchor_batches(cur: Centers, old: Centers | None, digits: int) -> Callable:
    """The anchor rows (``ANCHOR_SCHEMA``) of batches of ``features``, as ``_anchor_sql``."""
    dims = _dims(cur)
    cids, centers = np.array([c for c, _ in cur], dtype=np.int64), np.array([v for _, v in cur], dtype=np.float64).reshape(len(cur), dims)
    old_cids, before = ((np.array([c for c, _ in old], dtype=np.int64), np.array([v for _, v in old], dtype=np.float64).reshape(len(old), dims))
                        if old is not None else (None, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _vectors(batch.column("features"), dims)
            for piece in _pieces(len(every), dims):
                x = np.ascontiguousarray(every[piece])
                rows = np.arange(len(x))
                dist = _distances(x, centers)
                near = _least(dist, digits)
                d0, l0 = dist[rows, near], np.full(len(x), np.inf)
                if len(cids) > 1:
                    rest = dist.copy()
                    rest[rows, near] = np.inf
                    l0 = rest.min(axis=1)   # NaN stays: such a point is compared with all centroids in every step
                moved = np.ones(len(x), dtype=np.int64) if before is None else \
                    (old_cids[_least(_distances(x, before), digits)] != cids[near]).astype(np.int64)
                ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * dims)
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([packed, pa.array(cids[near]), pa.array(d0), pa.array(l0), pa.array(moved)],
                                                 names=["features", "c0", "d0", "l0", "sw0"])
    return run


def _step_batches(cur: Centers, old: Centers | None, base: Centers, dims: int, digits: int, at_anchor: bool) -> Callable:
    """One row (``PART_SCHEMA``) per cluster and part of the anchor: of the step that made the anchor (``at_anchor``), else as ``_step_sql``."""
    moves = {} if at_anchor else {"now": json.loads(_moves(base, cur)), "was": json.loads(_moves(base, old))}
    margin = 4 * 10.0 ** -digits

    def table(centers: Centers) -> tuple[np.ndarray, np.ndarray]:
        return np.array([c for c, _ in centers], dtype=np.int64), np.array([v for _, v in centers], dtype=np.float64).reshape(len(centers), dims)

    def step(x: np.ndarray, c0: np.ndarray, d0: np.ndarray, l0: np.ndarray) -> tuple[np.ndarray, ...]:
        cids, centers = table(cur)
        old_cids, before = table(old)
        here = {c: i for i, c in enumerate(cids.tolist())}
        labels, at = np.unique(c0, return_inverse=True)
        # of the anchor's clusters: NaN where a cluster is gone, and nothing is sure of its points
        pick = lambda which, name: np.array([moves[which].get(str(c), {}).get(name, np.nan) for c in labels.tolist()])
        cid, own = c0.copy(), np.full(len(x), np.nan)
        for i, c in enumerate(labels.tolist()):
            if c in here:
                mine = at == i
                diff = x[mine] - centers[here[c]]
                own[mine] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        sure = own + margin < l0 - pick("now", "slack")[at]
        stayed = d0 + pick("was", "drift")[at] + margin < l0 - pick("was", "slack")[at]
        dist, left = own, c0.copy()
        if not sure.all():
            far = _distances(x[~sure], centers)
            near = _least(far, digits)
            cid[~sure], dist[~sure] = cids[near], far[np.arange(len(far)), near]
        if not stayed.all():
            left[~stayed] = old_cids[_least(_distances(x[~stayed], before), digits)]
        return cid, dist, left != cid, 2 - sure.astype(np.int64) - stayed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            packed = batch.column("features")
            first, ends = 8 * dims * packed.offset, packed.buffers()[2]
            every = np.frombuffer(ends, dtype=np.float64, count=len(packed) * dims, offset=first).reshape(len(packed), dims) \
                if len(packed) and dims else np.empty((len(packed), dims))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("c0", "d0", "l0", "sw0")]
            for piece in _pieces(len(every), dims):
                x, (c0, d0, l0, sw0) = every[piece], (c[piece] for c in columns)
                cid, dist, sw, crossed = (c0, d0, sw0, np.zeros(len(x), dtype=np.int64)) if at_anchor else step(x, c0, d0, l0)
                order = np.argsort(cid, kind="stable")
                labels, starts, counts = np.unique(cid[order], return_index=True, return_counts=True)
                parts = [np.add.reduceat(v[order].astype(t), starts, axis=0) for v, t in
                         ((dist, np.float64), (sw, np.int64), (crossed, np.int64), (x, np.float64))]
                for i, c in enumerate(labels.tolist()):
                    row = total.setdefault(c, [0, 0.0, 0, 0, np.zeros(dims)])
                    for j, v in enumerate((int(counts[i]), *(p[i] for p in parts))):
                        row[j] = row[j] + v
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), *(pa.array([r[j] for r in total.values()], t) for j, t in
                                                      enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))))],
                names=["cid", "n", "sum_dist", "sw", "crossed", "sums"])
    return run


def _totals(parts: DataFrame) -> DataFrame:
    """``PART_SCHEMA`` rows added up by cluster."""
    return parts.groupBy("cid").agg(*[F.sum(c).alias(c) for c in ("n", "sum_dist", "sw", "crossed")], vector_sum("sums").alias("sums"))


def _loop(points: DataFrame, cur: Centers, dims: int, max_steps: int, digits: int) -> KMeansResult:
    prev: Centers | None = None
    cores = points.sparkSession.sparkContext.defaultParallelism
    spread = points.select("features")
    if spread.rdd.getNumPartitions() < cores:   # a small input in few files: dealt out once per anchor, so every core has a part
        spread = spread.repartition(cores)
    base: Centers = []                 # the centroids of the anchor
    anchor: DataFrame | None = None
    fresh = paid = 0                   # evaluations of the first step on the anchor, and those its age has added
    step, trace, evaluations = 0, [], []
    try:
        while True:
            k = len(cur)
            renewed = anchor is None or paid >= 2 * k * n
            if renewed:
                if anchor is not None:
                    anchor.unpersist()
                anchor = spread.mapInArrow(_anchor_batches(cur, prev, digits), ANCHOR_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
                base, fresh, paid = cur, None, 0
            parts = anchor.mapInArrow(_step_batches(cur, prev, base, dims, digits, renewed), PART_SCHEMA)
            rows = _totals(parts).collect()   # at most k rows
            n = sum(r["n"] for r in rows)
            moved = sum(r["sw"] for r in rows)
            total = sum(r["sum_dist"] for r in rows)
            trace.append((step, int(moved), float(total)))
            evaluations.append(k * n * (1 if prev is None else 2) if renewed else n + k * sum(r["crossed"] for r in rows))
            if not renewed:
                fresh = evaluations[-1] if fresh is None else fresh
                paid += max(0, evaluations[-1] - fresh)
            if moved == 0 or step == max_steps:
                err = (total ** 0.5) / n if n else float("nan")
                return KMeansResult(assign(points, cur), cur, err, step, moved == 0, trace, evaluations)
            nxt = sorted((int(r["cid"]), [round(s / r["n"], digits) for s in r["sums"]]) for r in rows)
            prev, cur = cur, nxt
            step += 1
    finally:
        if anchor is not None:
            anchor.unpersist()


def _step_aggregates(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("sum_dist"), F.sum("sw").alias("sw"),
                                       F.sum("crossed").alias("crossed"), vector_sum("features").alias("sums"))
