"""Best-fit packing of token sequences by hierarchical residual packing.

1. ``token_pieces`` encodes every text, ends it with ``end_id`` and cuts only what is longer than ``capacity``; the
   short piece comes first.
2. Every input partition packs its own pieces, longest first, each into the fullest open bin that still
   takes it. Bins with at most ``slack`` free places are final.
3. The underfull bins are the items of the next round: ``fan_in`` groups meet in one, and are packed in the same way, until one
   group is left or a group would hold more than ``group_items`` items and merging no longer helps.

Only piece numbers and lengths move between rounds. An item lists its members, at most ``capacity`` pieces.

Cases: null text is the empty text and gives one piece, the end id alone; rows with the same id are packed one by one
(their numbers in ``piece_row`` differ); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import numbered, stored, texts
from linkfold.llm.tokens import BATCH_CHARS, by_size, byte_bpe

_BIN = "grp long, open boolean, rows array<long>, lens array<int>"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids``: ``ids`` as little-endian unsigned 32-bit bytes."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts_here = b["text"].tolist()
            for i, j in by_size(texts_here, BATCH_CHARS):
                out = []
                for doc, ids in zip(b["doc_id"].iloc[i:j], byte_bpe(tokenizer).encode(texts_here[i:j])):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    out += [(doc, k, x, y - x, ids[4 * x:4 * y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])

    src = texts(docs)
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(fills: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin: longest item first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]   # open bins by free places
    rooms = 0                                                      # bit r: some open bin has r free places
    for item in np.argsort(-np.asarray(fills, dtype=np.int64), kind="stable").tolist():
        size = fills[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def _packed(group: int, rows: list, lens: list, capacity: int, slack: int) -> pd.DataFrame:
    """One group's items (lists of member pieces and their lengths) as packed bins."""
    fills = [int(sum(x)) for x in lens]
    bins = best_fit(fills, capacity)
    return pd.DataFrame({
        "grp": group,
        "open": [sum(fills[i] for i in b) < capacity - slack for b in bins],
        "rows": [np.concatenate([rows[i] for i in b]) for b in bins],
        "lens": [np.concatenate([lens[i] for i in b]) for b in bins],
    }, columns=["grp", "open", "rows", "lens"])


def pack(pieces: DataFrame, capacity: int = 2048, slack: int = 8, fan_in: int = 8,
         group_items: int = 200_000) -> DataFrame:
    """``piece_row, sequence_id, offset`` for ``pieces(piece_row, length)``.

    ``piece_row`` numbers the pieces; ``sequence_id`` is the least of a sequence's piece numbers.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, lens = [], []
        group = TaskContext.get().partitionId()   # and, from bit 32 on, the number of the go
        for b in batches:
            rows += [[r] for r in b["piece_row"].tolist()]
            lens += [[n] for n in b["length"].tolist()]
            if len(rows) >= group_items:   # a huge partition packs in several goes
                yield _packed(group, rows, lens, capacity, slack)
                rows, lens, group = [], [], group + (1 << 32)
        if rows:
            yield _packed(group, rows, lens, capacity, slack)

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _packed(int(key[0]), group["rows"].tolist(), group["lens"].tolist(), capacity, slack)

    level = stored(pieces.select("piece_row", "length").mapInPandas(local, _BIN), "pack-0")
    pid, go = F.col("grp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("grp", 32)
    first = level.agg(F.max(pid).alias("pid"), F.max(go).alias("go")).first()
    if first["go"]:   # every go is a group of its own
        level = level.withColumn("grp", go * F.lit(first["pid"] + 1) + pid)
    done, before = [], None
    while True:
        state = level.where("open").agg(F.count(F.lit(1)).alias("n"), (F.max("grp") + 1).alias("g"),
                                        F.countDistinct("grp").alias("k")).first()
        groups = max(-(-(state["g"] or 0) // fan_in), -(-state["n"] // group_items), 1)
        if state["n"] == 0 or state["k"] <= 1 or (before is not None and groups >= before[0] and state["n"] > 0.99 * before[1]):
            done.append(level)
            break
        done.append(level.where("not open"))
        before = (groups, state["n"])
        nxt = (level.where("open").withColumn("grp", F.pmod("grp", F.lit(groups)) if groups < state["g"]
                                              else F.pmod(F.xxhash64("rows"), F.lit(groups)))
               .groupBy("grp").applyInPandas(merged, _BIN))
        level = stored(nxt, f"pack-{len(done)}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    ends = F.transform("lens", lambda n, i: F.struct(
        F.element_at("rows", i + 1).alias("row"),
        F.aggregate(F.slice("lens", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x).alias("offset")))
    return (out.select(F.array_min("rows").alias("sequence_id"), F.explode(ends).alias("m"))
            .select(F.col("m.row").alias("piece_row"), "sequence_id", F.col("m.offset").alias("offset")))


def packed_sequences(pieces: DataFrame, layout: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed token ids, from ``pieces(piece_row, ids)`` and ``pack``'s layout."""
    placed = pieces.select("piece_row", "ids").join(layout, "piece_row")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))   # at most `capacity` ids a sequence
    return (placed.groupBy("sequence_id").agg(parts.alias("_p"))
            .select("sequence_id", F.aggregate("_p", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
            .select("sequence_id", (F.length("ids") / 4).cast("long").alias("length"), "ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, **options) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, piece_row``.

    The ids themselves stay out of the shuffles; ``token_pieces`` gives them again.
    """
    pieces = numbered(token_pieces(docs, tokenizer, end_id, capacity)
                      .select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")),
                      "pieces", "piece_row")
    return pieces.join(pack(pieces, capacity, **options), "piece_row")
