"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines; longer ones are cut at words chosen by their own hash, so an edit moves few cuts, and at the
latest after ``LONGEST`` words) are hashed to 64 bits, repeats apart. The sketch adds each digest to three cells: a count, the XOR of the digests and the XOR of
their checksums. Two versions' sketches are subtracted cell by cell, which leaves only what differs, and peeling takes out one
digest after the other from cells that hold just one. If cells are left over, both sketches are built again four times
larger, with other hashes. From what differs, ``likeness`` is the Jaccard similarity of the two sets of paragraphs.

The fingerprint is the number of digests and the smallest sketch, so equal texts have equal fingerprints.

Cases: null text is the empty text (no paragraphs; like another empty text 1, else 0); null ids come first; rows with the same id
follow one another by the first 64 characters of their texts, then by a digest of them; one row alone is its own next document; an empty
table gives an empty result. Ids may be of any type that sorts and casts to a string and back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkfold.llm.common import in_id_order, stored

RESULT = ("doc_id string, n_chars long, edited_sha256 binary, size long, cells binary, edited_size long, edited_cells binary, "
          "near_edited double, near_next double")
EDGES = "part int, first string, last string, last_id string"
BATCH_CHARS = 1 << 20     # texts of so many characters are compared at once
HELD_CELLS = 1 << 18      # cells of the sketches that are subtracted at once, if not of one text
CELLS, HASHES = 15, 3     # cells of the least sketch, cells that a digest is added to
LONG, LONGEST = 6, 16     # words of a line that stays whole, most words of a part
_U = np.uint64


def paragraphs(text: str) -> list[str]:
    """Lines that are not blank; those of more than ``LONG`` words in parts, cut after words whose hash says so (one in four)."""
    out = []
    for line in text.split("\n"):
        words = line.split(" ")
        if len(words) <= LONG:
            if line:
                out.append(line)
            continue
        start = 0
        for i, w in enumerate(words, 1):
            if i - start >= LONGEST or not zlib.crc32(w.encode("utf-8", "surrogatepass")) & 3:
                out.append(" ".join(words[start:i]))
                start = i
        if start < len(words):
            out.append(" ".join(words[start:]))
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(31)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, digest)`` of every paragraph; a text's second, third, ... copy of one has a digest of its own."""
    h = xxhash.xxh3_64_intdigest
    found = [np.array([h(p.encode("utf-8", "surrogatepass")) for p in paragraphs(t)], _U) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    d = np.concatenate([np.zeros(0, _U), *found])
    order = np.lexsort((d, owner))
    owner, d = owner[order], d[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (d[1:] != d[:-1])])[:len(d)]
    at = np.arange(len(d))
    copy = at - np.maximum.accumulate(np.where(new, at, 0)) if len(d) else at
    return owner, np.where(copy > 0, _mix(d + copy.astype(_U), 77), d)


class Sketches:
    """Sketches of ``n`` texts with ``cells`` cells each (a multiple of three)."""

    def __init__(self, n: int, cells: int, owner: np.ndarray, d: np.ndarray):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.keys, self.sums = np.zeros(n * cells, _U), np.zeros(n * cells, _U)
        self._add(owner, d, 1)

    def _places(self, owner: np.ndarray, d: np.ndarray) -> Iterator[np.ndarray]:
        part = self.cells // HASHES
        for j in range(HASHES):
            yield owner * self.cells + j * part + (_mix(d, self.cells + j) % _U(part)).astype(np.int64)

    def _add(self, owner: np.ndarray, d: np.ndarray, sign) -> None:
        check = self.check(d)
        for at in self._places(owner, d):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, d)
            np.bitwise_xor.at(self.sums, at, check)

    @staticmethod
    def check(d: np.ndarray) -> np.ndarray:
        return _mix(d, 12345) >> _U(32)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells, np.zeros(0, np.int64), np.zeros(0, _U))
        out.count, out.keys, out.sums = self.count - other.count, self.keys ^ other.keys, self.sums ^ other.sums
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take out what can be: ``(owner, digest, sign)`` of each, and which texts' sketches came out empty.

        A cell of several digests may pass for one by chance (32 bits of checksum). It would be taken out and put back without end, so
        a digest must belong to its cell, the rounds are as many as a text's cells (each round empties one for good), and a text
        that gave a digest twice does not count as empty.
        """
        got = []
        for _ in range(self.cells):
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[self.check(self.keys[at]) == self.sums[at]]
            at = at[np.any([p == at for p in self._places(at // self.cells, self.keys[at])], axis=0)]
            if not len(at):
                break
            owner, d, sign = at // self.cells, self.keys[at], self.count[at]
            order = np.lexsort((d, owner))
            owner, d, sign = owner[order], d[order], sign[order]
            one = np.concatenate([[True], (owner[1:] != owner[:-1]) | (d[1:] != d[:-1])])
            owner, d, sign = owner[one], d[one], sign[one]
            got.append((owner, d, sign))
            self._add(owner, d, -sign)
        left = (self.count != 0) | (self.keys != 0) | (self.sums != 0)
        empty = ~left.reshape(self.n, self.cells).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)]
        order = np.lexsort((parts[1], parts[0]))
        owner, d = parts[0][order], parts[1][order]
        empty[owner[1:][(owner[1:] == owner[:-1]) & (d[1:] == d[:-1])]] = False
        return *parts, empty

    def cells_of(self) -> list[bytes]:
        """Each text's cells: the count (16 bits), the XOR of the digests (64) and that of their checksums (32), little-endian."""
        cell = np.zeros(self.n * self.cells, [("n", "<i2"), ("key", "<u8"), ("sum", "<u4")])
        cell["n"], cell["key"], cell["sum"] = self.count, self.keys, self.sums
        data, step = cell.tobytes(), self.cells * cell.itemsize
        return [data[i * step:(i + 1) * step] for i in range(self.n)]


def likeness(n: int, a: tuple, b: tuple) -> np.ndarray:
    """Jaccard similarity of the paragraphs of ``n`` pairs of texts, from subtracted and peeled sketches."""
    na, nb = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    only = np.zeros(n, np.int64)
    todo, cells = np.arange(n), CELLS
    while len(todo):
        full = []
        for some in np.array_split(todo, min(len(todo), -(-len(todo) * cells // HELD_CELLS))):
            diff = Sketches(len(some), cells, *picked(a, some)).minus(Sketches(len(some), cells, *picked(b, some)))
            owner, _, sign, empty = diff.peel()
            only[some[empty]] = np.bincount(owner[sign > 0], minlength=len(some))[empty]
            full.append(some[~empty])
        todo, cells = np.concatenate(full), cells * 4
    both = na - only
    either = na + nb - both
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first (or all of them)."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def picked(found: tuple[np.ndarray, np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some of the texts (``texts``: their numbers), numbered anew in that order."""
    owner, d = found
    start = np.searchsorted(owner, texts)
    n = np.searchsorted(owner, texts, side="right") - start
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    return np.repeat(np.arange(len(texts)), n), d[at]


def compare(ids: list, texts: list[str]) -> pd.DataFrame:
    """A row for each text but the last, with the one that follows it."""
    changed = [edited(t, after) for t, after in zip(texts, texts[1:])]
    n, whole = len(changed), digests(texts)
    own, nxt, alt = picked(whole, np.arange(n)), picked(whole, np.arange(1, n + 1)), digests(changed)
    size = lambda x: np.bincount(x[0], minlength=n)
    return pd.DataFrame({
        "doc_id": ids[:n], "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest() for c in changed],
        "size": size(own), "cells": Sketches(n, CELLS, *own).cells_of(),
        "edited_size": size(alt), "edited_cells": Sketches(n, CELLS, *alt).cells_of(),
        "near_edited": likeness(n, own, alt), "near_next": likeness(n, own, nxt)})


def compared(ordered: DataFrame, rows: int) -> DataFrame:
    """``RESULT`` of every row of a range partition but its last, whose next one lies in another partition: that one, and the text
    that the partition begins with, leave as one ``EDGES`` row. At most ``rows`` texts, or few more than ``BATCH_CHARS``, are held."""
    result, edge = ([c.split()[0] for c in x.split(", ")] for x in (RESULT, EDGES))

    def with_nulls(frame: pd.DataFrame, missing: list[str]) -> pd.DataFrame:
        return frame.astype(object).assign(**{c: [None] * len(frame) for c in missing})[[*result, *edge]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first = TaskContext.get().partitionId(), None
        ids, texts, chars = [], [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                first = text if first is None else first
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if len(ids) > 1 and (len(ids) > rows or chars > BATCH_CHARS):
                    yield with_nulls(compare(ids, texts), edge)
                    ids, texts, chars = ids[-1:], texts[-1:], len(text)
        if len(ids) > 1:
            yield with_nulls(compare(ids, texts), edge)
        if ids:
            yield with_nulls(pd.DataFrame({"part": [part], "first": [first], "last": texts[-1:], "last_id": ids[-1:]}, dtype=object), result)

    return ordered.mapInPandas(run, f"{RESULT}, {EDGES}")


def across(edges: DataFrame) -> DataFrame:
    """``RESULT`` of the partitions' last rows: each meets the first text of the next partition that has rows (the last: of the first).
    One row a partition; only their numbers go through the window."""
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = edges.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(whole)).alias("after"))
    pairs = (edges.select("part", "last_id", "last").join(follows, "part")
             .join(edges.select(F.col("part").alias("after"), "first"), "after").select("last_id", "last", "first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, last, first in zip(b["last_id"], b["last"], b["first"]):
                yield compare([doc, None], [last, first])

    return pairs.mapInPandas(run, RESULT)


def fingerprint_edits(docs: DataFrame, part_rows: int | None = None, rows: int = 400) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    One shuffle brings the texts into range partitions by id (the session's number of them, or one for about ``part_rows`` rows), where each
    document is compared with the next. What lies across two partitions comes from one row a partition, in a second small job.
    The results of the first (no texts but those) are written to the checkpoint folder.
    """
    parts = None if part_rows is None else max(1, -(-docs.count() // part_rows))
    ordered = in_id_order(docs, "sketch-docs", parts).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = stored(compared(ordered, rows), "sketches")
    edges = found.where("part is not null").select("part", "first", "last", "last_id")
    inner = found.where("part is null").drop("part", "first", "last", "last_id")
    fingerprint = lambda n, cells: F.concat_ws(":", F.col(n).cast("string"), F.base64(cells))
    return inner.unionByName(across(edges)).select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        fingerprint("size", "cells").alias("fingerprint"), fingerprint("edited_size", "edited_cells").alias("edited_fingerprint"),
        "near_edited", "near_next")
