"""SimHash near-duplicates by vantage-point trees.

``fingerprints`` gives each text 64 bits from the XXH64 hashes of its word shingles. Equal fingerprints are one class;
only classes are compared:

1. A tree is fitted on a bounded sample of the fingerprints (``sample`` of them, by hash order). A node holds a vantage
   point and a radius, chosen among several for the rows they deal. Points within the radius go to the inner shard, the others to the
   outer one, and of the two strips along the boundary (by the triangle inequality no other points can be within ``max_bits`` across
   it) the smaller one is also sent to the other side, as queries, which are pruned on their way down. Every pair within ``max_bits``
   meets in exactly one shard.
2. Every fingerprint is routed through the tree; shards are Spark groups. A shard above ``shard_cap`` points, which
   happens where near copies are dense, is compared in blocks: stored blocks in pairs, and each stored block with each block of queries.
3. Inside a group the same splitting goes on down to small arrays, compared bit by bit: an exact check, no recall loss.
   A group gives a spanning forest of its links, never all pairs.
4. The forests' edges are joined by the library's connected components.

Cases: null text is the empty text; texts without words have fingerprint zero and link like any other; rows with the same
id count as one document (``drop_near_duplicates`` can take them apart); a row with a null id is a document of its own, takes
the least other id of its component and is never a component's id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import boxed, stored, texts
from linkfold.llm.exact_dedup import sha256
from linkfold.operators.components import connected_components
from linkfold.operators.sampling import least_by_hash

_BLOCK = 1 << 16


def shingle_hashes(data: bytes, width: int) -> Iterator[list[int]]:
    """XXH64 (seed 42) of the shingles of a UTF-8 text, in blocks; A-Z lower-cased, ASCII white space splits words."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield [xxhash.xxh64_intdigest(joined, 42)]
        return
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    h = xxhash.xxh64_intdigest
    for i in range(0, len(words) - width + 1, _BLOCK):
        yield [h(joined[s:e], 42) for s, e in zip(starts[i:i + _BLOCK], ends[i + width - 1:i + _BLOCK + width - 1])]


def fingerprint(data: bytes, width: int = 4) -> int:
    """Bit k is 1 if it is set in over half of the hashes, repeats included."""
    ones, n = np.zeros(64, np.int64), 0
    for block in shingle_hashes(data, width):
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, digest: bool = False) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as a signed long with the fingerprint's bits; with ``digest`` also ``_sha``, the text's SHA-256."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b["text"]], "<u8").view("<i8")
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "fp": fps, **({"_sha": b["_sha"].array} if digest else {})})

    src = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"),
                             *([sha256(F.col("text")).alias("_sha")] if digest else []))
    return src.mapInPandas(run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long" + (", _sha binary" if digest else ""))


# ---------------------------------------------------------------- vantage-point trees

def _bits(a: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(a ^ np.uint64(point)).astype(np.int16)


def _split(node: tuple, a: np.ndarray, ia: np.ndarray, ib: np.ndarray | None, r: int):
    """The parts of a comparison under a vantage point: ``(first side, second side or None)``, as index arrays.

    ``ib`` None: all pairs of ``ia``; else the pairs of ``ia`` with ``ib``.
    """
    point, mid = node
    da = _bits(a[ia], point)
    inner, outer = ia[da <= mid], ia[da > mid]
    near_in, near_out = ia[(da <= mid) & (da > mid - r)], ia[(da > mid) & (da <= mid + r)]
    if ib is None:
        return [(inner, None), (outer, None), (near_in, near_out)]
    db = _bits(a[ib], point)
    return [(inner, ib[db <= mid]), (outer, ib[db > mid]),
            (near_in, ib[(db > mid) & (db <= mid + r)]), (near_out, ib[(db <= mid) & (db > mid - r)])]


def _vantage(a: np.ndarray, ia: np.ndarray) -> tuple | None:
    """A point of the set and the median distance to it; None if that splits nothing off."""
    point = int(a[ia[len(ia) // 2]])
    d = _bits(a[ia], point)
    mid = int(np.median(d))
    if mid >= d.max():
        mid = int(d.max()) - 1
    return (point, mid) if mid >= 0 else None


def _choose(sample: np.ndarray, stored: np.ndarray, queries: np.ndarray, r: int, tries: int = 8) -> tuple[int, int, bool] | None:
    """``(vantage, radius, whether the inner strip is sent)``: of several vantage points and all radii the one that deals the fewest
    further rows for each bit that it tells apart; None if every cut deals most rows twice."""
    n, best, score = len(stored), None, math.inf
    for t in range(tries):
        point = int(sample[stored[(2 * t + 1) * n // (2 * tries)]])
        # points and queries up to each distance, with r places of padding on either side
        held, asked = (np.pad(np.cumsum(np.bincount(_bits(sample[x], point), minlength=65)), r, mode="edge") for x in (stored, queries))
        held[:r] = asked[:r] = 0
        for mid in range(64):
            at = mid + r
            share = held[at] / n
            if not 0.1 <= share <= 0.9:
                continue
            near_in, near_out = held[at] - held[at - r], held[at + r] - held[at]
            more = min(near_in, near_out) + asked[at + r] - asked[at - r]
            told = -share * math.log2(share) - (1 - share) * math.log2(1 - share)
            if more <= 0.75 * (n + len(queries)) and more / told < score:
                best, score = (point, mid, bool(near_in <= near_out)), more / told
    return best


def _sides(node: tuple[int, int, bool], a: np.ndarray, stored: np.ndarray, queries: np.ndarray, r: int):
    """The inner and the outer part, each as ``(stored, queries)``. Every stored point is in one of them; the smaller strip along the
    boundary is sent as queries to the other side, and a query goes wherever the triangle inequality leaves room for a link."""
    point, mid, send_inner = node
    d, q = _bits(a[stored], point), _bits(a[queries], point)
    inner, outer = [queries[q <= mid + r]], [queries[q > mid - r]]
    if send_inner:
        outer.append(stored[(d <= mid) & (d > mid - r)])
    else:
        inner.append(stored[(d > mid) & (d <= mid + r)])
    return (stored[d <= mid], np.concatenate(inner)), (stored[d > mid], np.concatenate(outer))


def fit_tree(sample: np.ndarray, total: int, shard: int, r: int, least: int = 64):
    """Nested ``(node, inner, outer)``; a leaf is its number. Splits until a shard is expected to hold ``shard`` points or
    the sample has fewer than ``least`` in it."""
    scale, leaves = total / max(1, len(sample)), [0]

    def build(stored, queries):
        node = _choose(sample, stored, queries, r) if len(stored) * scale > shard and len(stored) >= least else None
        if node is None:
            leaves[0] += 1
            return leaves[0] - 1
        return node, *[build(*side) for side in _sides(node, sample, stored, queries, r)]

    return build(np.arange(len(sample)), np.zeros(0, int))


def route(tree, a: np.ndarray, r: int) -> list[tuple[int, int, np.ndarray]]:
    """``(shard, side, indices)``: side 0, the points that the shard stores, is compared with itself and with side 1, the queries.
    Every pair within ``r`` bits meets in one shard, once."""
    out = []

    def go(node, stored, queries):
        if isinstance(node, int):
            out.extend((node, side, x) for side, x in ((0, stored), (1, queries)) if len(x))
            return
        for child, side in zip(node[1:], _sides(node[0], a, stored, queries, r)):
            if len(side[0]) or len(side[1]):
                go(child, *side)

    go(tree, np.arange(len(a)), np.zeros(0, int))
    return out


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the pairs, in place: every point's label becomes the least index linked to it."""
    while True:
        a, b = labels[i], labels[j]
        k = a != b
        if not k.any():
            return
        i, j = i[k], j[k]
        np.minimum.at(labels, np.maximum(a, b)[k], np.minimum(a, b)[k])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def link(a: np.ndarray, ia: np.ndarray, ib: np.ndarray | None, r: int, labels: np.ndarray, small: int = 1024) -> None:
    """Join the labels of all pairs within ``r`` bits: ``ia`` among itself, or ``ia`` with ``ib``."""
    if len(ia) == 0 or (ib is not None and len(ib) == 0):
        return
    n = len(ia) * (len(ia) if ib is None else len(ib))
    v = _vantage(a, ia) if n > small * small else None
    if v is not None:
        parts = _split(v, a, ia, ib, r)
        if sum(len(x) * (len(x) if y is None else 2 * len(y)) for x, y in parts) < 0.9 * n * (1 if ib is None else 2):
            for x, y in parts:
                link(a, x, y, r, labels, small)
            return
    ib = ia if ib is None else ib
    step = max(1, (1 << 19) // max(1, len(ib)))
    for s in range(0, len(ia), step):
        x, y = np.nonzero(np.bitwise_count(a[ia[s:s + step], None] ^ a[None, ib]) <= r)
        _join_labels(labels, ia[s:s + step][x], ib[y])


# ---------------------------------------------------------------- the join

def near_links(reps: DataFrame, max_bits: int = 4, sample: int = 100_000, shard: int = 20_000,
               shard_cap: int = 100_000) -> DataFrame:
    """``(a, b)``: a spanning forest per shard of the links between the classes ``reps(fp, rep)``."""
    total = reps.count()
    picked = (least_by_hash(reps.select("fp"), F.xxhash64("fp"), sample, -1 << 63, (1 << 63) - 1, ["fp"])
              .toPandas()["fp"].to_numpy("<i8").view("<u8"))
    tree = fit_tree(picked, total, shard, max_bits)

    def routed(batches):
        for b in batches:
            fp = b["fp"].to_numpy("<i8")
            parts = route(tree, fp.view("<u8"), max_bits)
            if parts:
                at = np.concatenate([i for _, _, i in parts])
                size = [len(i) for _, _, i in parts]
                yield pd.DataFrame({"shard": np.repeat([s for s, _, _ in parts], size),
                                    "side": np.repeat([d for _, d, _ in parts], size).astype(np.int8),
                                    "fp": fp[at], "rep": b["rep"].array[at]})

    kind = dict(reps.dtypes)["rep"]
    rows = stored(reps.mapInPandas(routed, f"shard long, side tinyint, fp long, rep {kind}"), "simhash-shards")

    # shards above the cap, at most (rows / cap) of them, are compared in groups: of stored blocks in pairs (one, where half the
    # cap holds all that is stored) and of a stored block with a block of queries. Side 2 is stored and only compared with queries.
    sizes = rows.groupBy("shard").agg(F.count(F.when(F.col("side") == 0, 1)).alias("n"), F.count(F.when(F.col("side") == 1, 1)).alias("q"))
    half = max(1, shard_cap // 2)
    big = sizes.where(F.col("n") + F.col("q") > shard_cap).selectExpr(
        "shard", f"int(greatest(1, ceil(n / {half}))) as bs",
        f"int(greatest(1, ceil(q / if(n <= {half}, {max(2, shard_cap)} - n, {half})))) as bq")
    dealt = (rows.join(F.broadcast(big), "shard", "left")
             .selectExpr("shard", "side", "fp", "rep", "coalesce(bs, 1) as bs", "coalesce(bq, 1) as bq", "xxhash64(fp, 1) as h")
             .selectExpr("*", "int(pmod(h, bs)) as i", "int(pmod(h, bq)) as j")
             .selectExpr("shard", "fp", "rep", """inline(case
                 when side = 0 and bs = 1 then transform(sequence(0, bq - 1), y -> named_struct('pair', y, 'to', if(y = 0, 0, 2)))
                 when side = 0 then concat(
                     transform(sequence(0, bs - 1), x -> named_struct('pair', least(x, i) * bs + greatest(x, i), 'to', 0)),
                     transform(sequence(0, bq - 1), y -> named_struct('pair', bs * bs + i * bq + y, 'to', 2)))
                 when bs = 1 then array(named_struct('pair', j, 'to', 1))
                 else transform(sequence(0, bs - 1), x -> named_struct('pair', bs * bs + x * bq + j, 'to', 1)) end) as (pair, to)"""))

    def forest(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = group["fp"].to_numpy("<i8").view("<u8")
        side, rep, labels = group["to"].to_numpy(), group["rep"].to_numpy(), np.arange(len(group))
        link(a, np.flatnonzero(side == 0), None, max_bits, labels)
        link(a, np.flatnonzero(side != 1), np.flatnonzero(side == 1), max_bits, labels)
        to = np.flatnonzero(labels != np.arange(len(a)))
        return pd.DataFrame({"a": rep[to], "b": rep[labels[to]]})

    return (dealt.groupBy("shard", "pair").applyInPandas(forest, f"a {kind}, b {kind}").where("a <> b"))


def _near_classes(fps: DataFrame, reps: DataFrame, max_bits: int, rows_apart: bool, **options) -> DataFrame:
    """``reps(fp, ...)`` with ``root``, the same for all classes of a component."""
    links = near_links(reps.select("fp", F.col("fp").alias("rep")), max_bits, **options)
    if not rows_apart:   # an id with several fingerprints joins their classes
        ids = fps.where("doc_id is not null")
        several = stored(ids.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_most")).where("a < _most")
                         .select(F.col("doc_id").alias("_i"), "a"), "simhash-ids")
        if not several.isEmpty():
            same = ids.select("doc_id", "fp").distinct().join(several, F.col("doc_id") == F.col("_i")).where("fp <> a")
            links = links.unionByName(same.select("a", F.col("fp").alias("b")).distinct())
    found = connected_components(links, "a", "b").membership()
    return stored(reps.join(found, reps["fp"] == found["node"], "left")
                  .select(*reps.columns, F.coalesce("component", "fp").alias("root")), "simhash-classes")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, **options) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, class_size`` (documents with that fingerprint)."""
    fps = stored(fingerprints(docs, width), "simhash-fps")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")), "simhash-reps")
    classes = _near_classes(fps, reps, max_bits, False, **options)
    least = stored(classes.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("component_id")), "simhash-least")
    named = stored(classes.join(least, F.col("root") == F.col("_root"))
                   .select(F.col("fp").alias("_fp"), "component_id", "class_size"), "simhash-named")
    return fps.join(named, fps["fp"] == named["_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def drop_near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, rows_apart: bool = False,
                         **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, a null id last, then with the least digest.

    ``rows_apart``: rows are documents of their own, also where they share an id.
    """
    fps = stored(fingerprints(docs, width, digest=True), "simhash-fps")
    # the row that stands for a class, and how many rows equal it in id and text
    same = fps.groupBy("fp", "doc_id", "_sha").agg(F.count(F.lit(1)).alias("_n"))
    reps = stored(same.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_sha", "_n"))
                                         .alias("best")), "simhash-reps")
    classes = _near_classes(fps, reps, max_bits, rows_apart, **options)
    kept = stored(classes.groupBy("root").agg(F.min("best").alias("best"))
                  .select(F.col("best.doc_id").alias("_keep"), F.col("best._sha").alias("_keep_sha"), F.col("best._n").alias("_n")),
                  "simhash-kept")
    rows = boxed(docs).withColumn("_sha", sha256(F.col("text"))).drop("text")
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_sha") == F.col("_keep_sha")))
    if kept.where("_n > 1").isEmpty():
        return rows.select("row.*")
    once = rows.where("_n > 1").dropDuplicates(["doc_id", "_sha"])   # rows equal in id and text
    return rows.where("_n = 1").select("row.*").unionByName(once.select("row.*"))
