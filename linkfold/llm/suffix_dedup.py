"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every byte position of a text starts a suffix; two suffixes matter only through their first ``window`` bytes. Sorting by
most-significant digits, a group with one member is done: its window occurs once. Groups that stay equal through ``window`` bytes are
exactly the repeated windows, and every byte of theirs goes.

Digits are long at first, so few rows are shuffled:

1. Digit one is the hash of ``key`` bytes at a window's anchor: of the ``window - key + 1`` places in it where ``key`` bytes fit, the
   one whose hash is least. Equal windows have equal anchors at the same place in them. Windows that follow one another
   mostly share an anchor, so a row stands for a run of some 75 windows. Anchors that occur once are done.
2. Digit two is the hash of all bytes of a run's windows. Runs equal in both digits are repeated in full, whatever their number:
   copies, however many, are settled by a count.
3. What is left are single runs whose anchor also occurs in other runs, at the edges of passages. Only one run of each kind goes
   on, with its bytes, and groups of equal anchors are sorted window by window through 8-byte digits, to the full depth.
   Anchors with more than ``group_runs`` different runs are sorted by whole-window hashes instead, counted and joined as Spark rows, so no
   group must fit a task.

Counts are partial aggregations and joins are Spark's, which splits skewed ones; nothing is broadcast by need. Each step's rows
are stored, and what earlier steps left is released.

Cases: null text is the empty text; texts under ``window`` bytes are never cut; ids may be null or repeated: rows equal in id and text are
two documents, whose windows repeat each other; matches never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkfold.llm.common import release, stored, text_or_empty

CHUNK = 1 << 18      # bytes that are hashed at a time
_AT = np.uint64((1 << 24) - 1)
_U = np.uint64


@cache
def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two polynomial hashes modulo 2^64: byte values, powers of the base and of its inverse."""
    out = []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 62)) * 2 + 1
        up = np.full(n, base, _U)
        down = np.full(n, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        out.append((rng.integers(0, 1 << 64, 256, _U, endpoint=False), np.cumprod(up), np.cumprod(down)))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hashes:
    """Hashes of substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        self.tables = _tables(size)
        self.sums = [np.concatenate([np.zeros(1, _U), np.cumsum(values[data] * up[:len(data)], dtype=_U)])
                     for values, up, _ in self.tables]

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mixed((s[end] - s[start]) * self.tables[which][2][start])

    def every(self, length: int) -> np.ndarray:
        s = self.sums[0]
        n = len(s) - length
        return _mixed((s[length:] - s[:n]) * self.tables[0][2][:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(_U).max, _U)]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, key: int):
    """The runs of windows with a common anchor, in texts ``data[starts:ends]``:
    ``(text number, first byte, length, anchor's place, anchor hash, run hash)``."""
    hashes = Hashes(data)
    h = hashes.every(key)
    order = (h & ~_AT) | np.arange(len(h), dtype=_U)
    anchor = (_sliding_min(order, window - key + 1) & _AT).astype(np.int64)
    ok = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= window
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - window + 1, -1)
    p = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    a = anchor[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])[:len(p)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])[:len(first)]
    low, end, at = p[first], p[last] + window, a[first]
    return (np.searchsorted(starts, low, side="right") - 1, low, end - low, at - low, h[at].view(np.int64),
            hashes.of(1, low, end).view(np.int64))


def _chunks(lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Parts of texts, ``(text, from, to)``, of about ``CHUNK`` bytes together. Parts of one text share ``window - 1`` bytes, so
    each window is in exactly one."""
    part, size = [], 0
    for i, n in enumerate(lengths.tolist()):
        for s in range(0, max(0, n - window + 1), CHUNK):
            part.append((i, s, min(n, s + CHUNK + window - 1)))
            size += part[-1][2] - s
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def text_runs(src: DataFrame, window: int, key: int) -> DataFrame:
    """``doc_id, doc_hash, start, length, place, h, run`` for ``src(doc_id, doc_hash, data)``."""
    fields = [f for f in src.schema.fields if f.name != "data"] + [
        T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("place", T.IntegerType()),
        T.StructField("h", T.LongType()), T.StructField("run", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index("data"))
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            for part in _chunks(np.diff(at), window):
                who, frm, to = (np.array(x, np.int64) for x in zip(*part))
                bounds = np.concatenate([[0], np.cumsum(to - frm)])
                joined = np.concatenate([data[at[i] + s:at[i] + e] for i, s, e in part])
                k, low, length, place, h, whole = runs(joined, bounds[:-1], bounds[1:], window, key)
                doc = pa.array(who[k])
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(f.name)).take(doc) for f in fields[:2]]
                    + [pa.array(low - bounds[k] + frm[k]), pa.array(length.astype(np.int32)), pa.array(place.astype(np.int32)),
                       pa.array(h), pa.array(whole)], names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def equal_windows(h: np.ndarray, place: np.ndarray, data: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort of the windows of runs: ``(run number, window's offset in it)`` of those that occur more than once.

    ``h`` sorted: windows can be equal only under the same anchor hash with the anchor at the same place.
    """
    buf = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    length = np.array([len(d) for d in data], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    n = length - window + 1
    run = np.repeat(np.arange(len(data)), n)
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))[run] * (2 * window) + (place[run] - rel)
    at = np.arange(len(run))
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    for d in range(-1, -(-window // 8)):
        if d < 0:
            digit = np.zeros(len(at), _U)
        else:
            pos = begin[run[at]] + rel[at] + min(8 * d, window - 8)
            digit = eight[pos].copy().view(">u8").ravel()
        order = np.lexsort((digit, group))
        at, g, digit = at[order], group[order], digit[order]
        gid = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])])[:len(g)])
        keep = np.bincount(gid, minlength=1)[gid] > 1 if len(gid) else np.zeros(0, bool)
        at, group = at[keep], gid[keep]
        if not len(at):
            break
    return run[at], rel[at]


_SPOT = "doc_id {kind}, doc_hash long, first long, last long"


def _sorted_groups(rows: DataFrame, window: int, kind: str, batch: int = 4000) -> DataFrame:
    """Windows of single runs that occur elsewhere, from runs dealt and sorted by anchor hash."""
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        run, rel = equal_windows(part["h"].to_numpy(), part["place"].to_numpy(), part["data"].tolist(), window)
        own = part["n"].to_numpy()[run] == 1
        run, rel = run[own], rel[own]
        order = np.lexsort((rel, run))
        run, rel = run[order], rel[order]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (rel[1:] != rel[:-1] + 1)])[:len(run)]
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(run) - 1]])[:len(first)]
        start = part["start"].to_numpy()[run[first]]
        return pd.DataFrame({"doc_id": part["doc_id"].array[run[first]], "doc_hash": part["doc_hash"].to_numpy()[run[first]],
                             "first": start + rel[first], "last": start + rel[last]})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            h = held["h"].to_numpy()
            while len(held) > batch and h[0] != h[-1]:
                # whole groups only; the last one may go on in the next batch
                whole = int(np.searchsorted(h, h[-1]))
                ends = np.flatnonzero(h[1:whole] != h[:whole - 1]) + 1
                ends = np.append(ends, whole)
                stop = int(ends[min(np.searchsorted(ends, batch), len(ends) - 1)])
                yield solve(held.iloc[:stop].reset_index(drop=True))
                held = held.iloc[stop:].reset_index(drop=True)
                h = held["h"].to_numpy()
        if held is not None and len(held):
            yield solve(held)

    return (rows.repartition("h").sortWithinPartitions("h")
            .mapInPandas(go, _SPOT.format(kind=kind)))


def _counted_windows(rows: DataFrame, window: int, kind: str) -> DataFrame:
    """The same for anchors with very many runs: windows as rows, counted by two hashes under anchor and place."""
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i:i + 1000]
                length = np.array([len(d) for d in part["data"]], np.int64)
                n = length - window + 1
                run = np.repeat(np.arange(len(part)), n)
                rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = (np.cumsum(length) - length)[run] + rel
                hashes = Hashes(np.frombuffer(b"".join(part["data"]), np.uint8))
                yield pd.DataFrame({
                    "h": part["h"].to_numpy()[run], "at": part["place"].to_numpy()[run] - rel,
                    "w1": hashes.of(0, at, at + window).view(np.int64), "w2": hashes.of(1, at, at + window).view(np.int64),
                    "doc_id": part["doc_id"].array[run], "doc_hash": part["doc_hash"].to_numpy()[run],
                    "first": part["start"].to_numpy()[run] + rel, "n": part["n"].to_numpy()[run]})

    windows = stored(rows.mapInPandas(explode, f"h long, at long, w1 long, w2 long, doc_id {kind}, doc_hash long, first long, n long"),
                     "suffix-windows")
    name = ["h", "at", "w1", "w2"]
    again = stored(windows.groupBy(*name).count().where("count > 1").select(*name), "suffix-windows-twice")
    return windows.where("n = 1").join(again, name).select("doc_id", "doc_hash", "first", F.col("first").alias("last"))


def repeated_windows(docs: DataFrame, window: int = 200, key: int = 50, group_runs: int = 5_000) -> DataFrame:
    """``doc_id, doc_hash, first, last``: the starts, from first to last, of windows that also start anywhere else."""
    spark = docs.sparkSession
    src = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("doc_hash"), text_or_empty().cast("binary").alias("data"))
    kind = dict(src.dtypes)["doc_id"]
    every = stored(text_runs(src, window, key), "suffix-runs")
    # joins read stored tables on both sides: only then can Spark split a key that holds a large share of the rows
    twice = stored(every.groupBy("h").count().where("count > 1").select("h"), "suffix-twice")
    alive = stored(every.join(twice, "h"), "suffix-alive")
    release(every)

    same = ["h", "run", "place", "length"]
    kinds = stored(alive.groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "doc_hash", "start")).alias("at")), "suffix-kinds")
    full = stored(alive.join(kinds.where("n > 1").select(*same), same)
                  .select("doc_id", "doc_hash", F.col("start").alias("first"), (F.col("start") + F.col("length") - window).alias("last")),
                  "suffix-full")
    release(alive)

    groups = stored(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("_kinds"), F.min("n").alias("_n"))
                    .where("_kinds > 1 and _n = 1"), "suffix-groups")
    edges = (kinds.join(groups, "h").select("h", "run", "place", "length", "n", "_kinds", "at.*"))
    by_doc = edges.groupBy(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h")).agg(
        F.collect_list(F.struct("start", "length", "place", "h", "run", "n", "_kinds")).alias("_runs"))   # of one text
    cut = (src.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")))
           .select("doc_id", "doc_hash", "data", F.explode("_runs").alias("r"))
           .select("doc_id", "doc_hash", "r.*", F.substring("data", F.col("r.start").cast("int") + 1, F.col("r.length")).alias("data")))
    rows = stored(cut, "suffix-edges")
    release(kinds)
    # rows equal in id and text give their runs twice; they are kinds of more than one member, so one is enough
    small = rows.where(F.col("_kinds") <= group_runs).dropDuplicates(same)
    spots = _sorted_groups(small, window, kind)
    large = rows.where(F.col("_kinds") > group_runs)
    if not large.isEmpty():
        spots = spots.unionByName(_counted_windows(large.dropDuplicates(same), window, kind))
    spots = stored(spots, "suffix-spots")
    release(rows)
    return full.unionByName(spots)


def remove_repeats(docs: DataFrame, window: int = 200, **options) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept``: the removed byte ranges, and the other bytes."""
    spots = repeated_windows(docs, window, **options)
    by_doc = spots.groupBy(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h")).agg(
        F.collect_set(F.struct("first", "last")).alias("found"))   # of one text, however many rows have it
    src = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("doc_hash"), text_or_empty().cast("binary").alias("data"))
    kind = dict(src.dtypes)["doc_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans, kept = [], []
            for data, found in zip(b["data"], b["found"]):
                mine = []
                if found is not None and len(found):
                    f = np.array([(x["first"], x["last"] + window) for x in found], np.int64)
                    f = f[np.argsort(f[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(f[:, 1])
                    new = np.flatnonzero(np.concatenate([[True], f[1:, 0] > reach[:-1]]))
                    mine = list(zip(f[new, 0].tolist(), reach[np.append(new[1:] - 1, len(f) - 1)].tolist()))
                spans.append([{"start": s, "end": e} for s, e in mine])
                edges = [0, *(x for s in mine for x in s), len(data)]
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "n_bytes": [len(d) for d in b["data"]], "spans": spans, "kept": kept})

    joined = src.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "data", "found").mapInPandas(
        cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
