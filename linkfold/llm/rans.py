"""Token ids as binary files, coded by a static range asymmetric numeral system (rANS).

Format. Files are Parquet parts in ascending ``doc_id`` order; a row is a segment of about ``segment_tokens`` ids:

* ``doc_ids``, ``doc_tokens``: the documents of the segment, whole, in order, their ids as strings (null: null);
* ``table``: the symbol frequencies that all blocks of the segment share, scaled to 2^18 (zlib of symbols and counts);
* ``blocks``: independent blocks of up to ``BLOCK`` ids. Id ``i`` of a block belongs to lane ``i % lanes``
  (``LANES``, fewer in small blocks); the lanes' 64-bit states write 32-bit words to one interleaved stream. ``checkpoints`` holds the lanes' states and the place in the stream
  for every ``EVERY`` steps, so a decoder starts at any of them, or at all at once, as this one does. ``crc32`` is that of the
  block's ids as little-endian unsigned 32-bit integers; a mismatch raises.

A segment is read by its row alone and a block by the row's table, in any order, by any number of tasks.

Cases: a null text is the empty text and gives the end id alone; rows with the same id stay apart, in the order of the first 64
characters of their texts, then of a digest; null ids come first; an empty table writes no segment and reads as an empty result. Ids may
be of any type that sorts and casts to a string and back; readers take the type (``long`` if not told).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm.common import in_id_order, running_total
from linkfold.llm.tokens import BATCH_CHARS, by_size, byte_bpe

SCALE, LOW, LANES, EVERY, BLOCK = 18, 31, 2048, 128, 1 << 20
_U = np.uint64

SEGMENTS = ("file int, segment int, n_tokens long, doc_ids array<string>, doc_tokens array<long>, table binary, "
            "blocks array<struct<n: int, lanes: int, checkpoints: binary, payload: binary, crc32: long>>")


class Table:
    """Symbol frequencies that add up to 2^18; every symbol that occurs has at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype("<u4"), freqs.astype("<u4")
        self.f = self.freqs.astype(_U)
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(_U)
        self._slots = self._numbers = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        if len(symbols) > 1 << SCALE:
            raise ValueError(f"{len(symbols)} different symbols; a table holds {1 << SCALE}")
        freqs = np.maximum(1, (counts * (1 << SCALE)) // counts.sum())
        order = np.argsort(-freqs, kind="stable")
        off = (1 << SCALE) - int(freqs.sum())
        if off > 0:
            freqs[order[0]] += off
        for at in order if off < 0 else ():
            step = min(int(freqs[at]) - 1, -off)
            freqs[at] -= step
            off += step
            if not off:
                break
        return cls(symbols, freqs)

    def to_bytes(self) -> bytes:
        return zlib.compress(np.diff(self.symbols, prepend=0).astype("<u4").tobytes() + self.freqs.tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        a = np.frombuffer(zlib.decompress(data), "<u4")
        return cls(np.cumsum(a[:len(a) // 2], dtype=np.int64), a[len(a) // 2:])

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id among the table's symbols."""
        if self._numbers is None:
            self._numbers = np.zeros(int(self.symbols[-1]) + 1, np.int64)
            self._numbers[self.symbols] = np.arange(len(self.symbols))
        return self._numbers[ids]

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols)), self.freqs)
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> dict:
    sym = table.numbers(ids)
    n = len(ids)
    lanes = LANES if n >= BLOCK // 4 else max(16, LANES >> max(0, (BLOCK // 4 // n).bit_length()))
    steps = -(-n // lanes)
    x = np.full(lanes, 1 << LOW, _U)
    words, counts = [None] * steps, np.zeros(steps, np.int64)
    states = []
    for t in range(steps - 1, -1, -1):
        s = sym[t * lanes:(t + 1) * lanes]
        y, f = x[:len(s)], table.f[s]
        full = y >= f << _U(LOW - SCALE + 32)
        words[t] = (y[full] & _U(0xFFFFFFFF)).astype("<u4")
        counts[t] = len(words[t])
        y = np.where(full, y >> _U(32), y)
        q = y // f
        x[:len(s)] = (q << _U(SCALE)) + (y - q * f) + table.c[s]
        if t % EVERY == 0:
            states.append(x.copy())
    at = np.concatenate([[0], np.cumsum(counts)])[0:steps:EVERY]
    return {"n": n, "lanes": lanes, "checkpoints": at.astype("<u8").tobytes() + np.concatenate(states[::-1]).astype("<u8").tobytes(),
            "payload": np.concatenate(words).tobytes(), "crc32": zlib.crc32(np.ascontiguousarray(ids, "<u4"))}


def _decode_runs(states: np.ndarray, at: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """``n`` ids from each of several checkpoints at once: rows of ``states`` and places ``at`` in the stream."""
    runs, lanes = states.shape
    steps = -(-n // lanes)
    x, at = states.copy(), at.copy()
    out = np.empty((runs, steps * lanes), np.int64)
    for t in range(steps):
        m = min(lanes, n - t * lanes)
        y = x[:, :m]
        slot = y & _U((1 << SCALE) - 1)
        s = table.slots[slot]
        y = table.f[s] * (y >> _U(SCALE)) + slot - table.c[s]
        out[:, t * lanes:t * lanes + m] = s
        short = y < _U(1 << LOW)
        rank = np.cumsum(short, axis=1)
        take = (at[:, None] + rank - 1)[short]
        y[short] = (y[short] << _U(32)) | words[take]
        at += rank[:, -1]
        x[:, :m] = y
    return table.symbols[out[:, :n]]


def decode_block(block, table: Table) -> np.ndarray:
    n, lanes = block["n"], block["lanes"]
    points = -(-(-(-n // lanes)) // EVERY)
    head = np.frombuffer(block["checkpoints"], "<u8")
    at, states = head[:points].astype(np.int64), head[points:].reshape(points, lanes)
    words = np.frombuffer(block["payload"], "<u4").astype(_U)
    run = EVERY * lanes
    parts = [_decode_runs(states[:-1], at[:-1], words, run, table).ravel()] if points > 1 else []
    parts.append(_decode_runs(states[-1:], at[-1:], words, n - (points - 1) * run, table).ravel())
    ids = np.ascontiguousarray(np.concatenate(parts), "<u4")
    if zlib.crc32(ids) != block["crc32"]:
        raise ValueError("checksum mismatch: a block is damaged")
    return ids


def segment_row(file: int, segment: int, doc_ids: list, docs: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(docs), "<u4")
    table = Table.of(ids)
    return {"file": file, "segment": segment, "n_tokens": len(ids), "doc_ids": doc_ids,
            "doc_tokens": [len(d) // 4 for d in docs], "table": table.to_bytes(),
            "blocks": [encode_block(ids[i:i + BLOCK], table) for i in range(0, len(ids), BLOCK)]}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_tokens: int = 1 << 21) -> None:
    """Encode every text, end it with ``end_id`` and write the files at ``path``, range-partitioned by ``doc_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, segment, n, ids, held = TaskContext.get().partitionId(), 0, 0, [], []
        columns = [c.split()[0] for c in SEGMENTS.split(", ") if " " in c][:7]
        for b in batches:
            known = [None if null else x for x, null in zip(b["doc_id"], b["doc_id"].isna())]
            texts_here = b["text"].tolist()
            for i, j in by_size(texts_here, BATCH_CHARS):
                for doc, data in zip(known[i:j], byte_bpe(tokenizer).encode(texts_here[i:j])):
                    ids.append(doc)
                    held.append(data + end)
                    n += len(data) // 4 + 1
                    if n >= segment_tokens:
                        yield pd.DataFrame([segment_row(file, segment, ids, held)], columns=columns)
                        segment, n, ids, held = segment + 1, 0, [], []
        if held:
            yield pd.DataFrame([segment_row(file, segment, ids, held)], columns=columns)

    ordered = in_id_order(docs, "token-docs").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ordered.mapInPandas(run, SEGMENTS).write.parquet(path)


def decoded(segment) -> Iterator[tuple[str | None, int, bytes]]:
    """``(doc_id, ids before it in the segment, ids as bytes)`` of a segment's documents."""
    table = Table.from_bytes(segment.table)
    data = b"".join(decode_block(block, table).tobytes() for block in segment.blocks)
    at = 0
    for doc, n in zip(segment.doc_ids, segment.doc_tokens):
        yield doc, at, data[4 * at:4 * (at + n)]
        at += int(n)


def _read(spark: SparkSession, path: str, columns: list[str], schema: str, id_type: str, of) -> DataFrame:
    """A row for each document from its segment: ``file``, ``segment`` and what ``of(doc_id, at, ids)`` gives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for segment in b.itertuples(index=False):
                docs = decoded(segment)
                while part := list(islice(docs, 1000)):   # small batches: a segment's ids leave the worker bit by bit
                    out = pd.DataFrame([of(*d) for d in part], columns=columns)
                    out.insert(0, "segment", segment.segment)
                    out.insert(0, "file", segment.file)
                    yield out

    rows = spark.read.schema(SEGMENTS).parquet(path).mapInPandas(run, f"file int, segment int, doc_id string, {schema}")
    return rows.withColumn("doc_id", F.col("doc_id").cast(id_type))


def read_token_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``file, segment, doc_id, at, n_tokens, ids``: every document's ids (little-endian unsigned 32-bit bytes); ``at`` counts the
    ids before it in its segment."""
    return _read(spark, path, ["doc_id", "at", "n_tokens", "ids"], "at long, n_tokens long, ids binary", id_type,
                 lambda doc, at, ids: (doc, at, len(ids) // 4, ids))


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """``file, segment, first``: the ids of all segments before. Reads the two numbers and the count, not the blocks."""
    rows = (spark.read.schema(SEGMENTS).parquet(path).select("file", "segment", "n_tokens")
            .withColumn("_all", F.lit(0)))
    return running_total(rows, "_all", "file", ["segment"], "n_tokens", "first").select("file", "segment", "first")


def token_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    docs = _read(spark, path, ["doc_id", "at", "n_tokens", "ids_crc32"], "at long, n_tokens long, ids_crc32 long", id_type,
                 lambda doc, at, ids: (doc, at, len(ids) // 4, zlib.crc32(ids)))   # the ids need not leave the task
    return (docs.join(segment_starts(spark, path), ["file", "segment"])
            .select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
