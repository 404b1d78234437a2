"""Audit of how filters interact, by truth-table survival words.

Each document fails some of the five filters. Its survival word has a bit for each of the 32 subsets of filters: the bit is
1 if the document survives the subset, that is, fails none of its filters. The sums of the words' bits (positional
popcounts, added up by carry-save adders in the tasks) say how many documents each subset leaves, per part and label, and
these 32 numbers give the audit of every order of the filters: the subset before a step and the subset after it.

Filters: A under 50 words; B ``100 * distinct words < 65 * words``; C ``100 * [A-Z] > 5 * code points``; D any of
``#$%&*|``; E the text of a document with a smaller id, wherever it is.

Only narrow rows are shuffled: an id, a digest and the failed filters. Copies are found by the (digest, id) of each text's
first document, so no key holds more than the rows that share an id and a text.

Cases: null text is the empty text; a null part is the part ``''``; a row with a null id fails E never and has no
label; rows with the same id count one by one, and as none is smaller, equal ones do not fail E by each other; several labels
of one id count together (good if any says quality 1, toxic if any says toxic 1); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkfold.llm.common import stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: the survival word of each set of failed filters: bit S is 1 if S holds none of them
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)
LABELS = ("all", "good", "toxic")

_SYMBOLS = frozenset(b"#$%&*|")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))   # every other byte of UTF-8 begins a code point
_SLAB = 1 << 20


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and different words of a UTF-8 text (ASCII white space splits), taken in slabs, so that only the set of words grows."""
    n, seen, rest = 0, set(), b""
    for i in range(0, len(data), _SLAB):
        words = (rest + data[i:i + _SLAB]).split()
        rest = b""
        if i + _SLAB < len(data) and words and not data[i + _SLAB - 1:i + _SLAB].isspace():
            rest = words.pop()   # may go on in the next slab
        n += len(words)
        seen.update(words)
    return n + bool(rest), len(seen | {rest} if rest else seen)


def failed_filters(data: bytes) -> int:
    """Bits 0 to 3: whether a text fails A, B, C, D."""
    n, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    code_points = len(data.translate(None, _CONTINUATION))
    return ((n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * code_points) << 2
            | (not _SYMBOLS.isdisjoint(data)) << 3)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set: three words of one weight become a word of that weight and a carry
    of twice the weight, until at most two words of each weight are left."""
    counts, planes, bits = np.zeros(SUBSETS, np.int64), [words.astype(np.uint32)], np.arange(SUBSETS, dtype=np.uint32)
    for weight, plane in enumerate(planes):   # grows while it runs
        carries = []
        while len(plane) > 2:
            third = len(plane) // 3
            a, b, c = (plane[k * third:(k + 1) * third] for k in range(3))
            half = a ^ b
            carries.append((a & b) | (half & c))
            plane = np.concatenate([half ^ c, plane[3 * third:]])
        for word in plane:
            counts += ((word >> bits) & np.uint32(1)).astype(np.int64) << weight
        if carries:
            planes.append(np.concatenate(carries))
    return counts


def checked(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """``(doc_id, part, failed)``, one row per document; bit k of ``failed`` is filter ``FILTERS[k]``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [bytes(t.as_buffer()) if t.is_valid else b"" for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([failed_filters(d) for d in data], pa.int32()),
                 pa.array([hashlib.sha256(d).digest() for d in data], pa.binary())], names=["doc_id", "part", "failed", "_d"])

    src = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    rows = stored(src.mapInArrow(run, T.StructType([
        src.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("failed", T.IntegerType()),
        T.StructField("_d", T.BinaryType())])), "audit-checked")
    first = (rows.where(F.col("doc_id").isNotNull()).groupBy("_d").agg(F.min("doc_id").alias("_first"))
             .select(F.col("_d").alias("_e"), "_first"))
    joined = rows.join(first, (F.col("_d") == F.col("_e")) & (F.col("doc_id") == F.col("_first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return joined.select("doc_id", "part", F.when(copy, F.col("failed") + (1 << 4)).otherwise(F.col("failed")).alias("failed"))


def survivors(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, label, subset, n)``: documents of the part and label that the subset of filters leaves. ``documents`` as
    ``checked`` gives it, ``labels(doc_id, quality, toxic)``."""
    documents = stored(documents, "audit-documents")
    marks = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
             .where("_good or _toxic"))
    # rows with a label come from an inner join, so that rows without an id are never dealt by it
    marked = (documents.join(marks, F.col("doc_id") == F.col("_id"))
              .withColumn("label", F.explode(F.array_compact(F.array(F.when(F.col("_good"), 1), F.when(F.col("_toxic"), 2)))))
              .select("part", "label", "failed"))
    every = documents.select("part", F.lit(0).alias("label"), "failed").unionByName(marked)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [(part, label, positional_popcount(WORDS[g.to_numpy()])) for (part, label), g in b.groupby(["part", "label"])["failed"]]
            if sums:   # a frame without rows has no types
                yield pd.DataFrame({"part": np.repeat([s[0] for s in sums], SUBSETS), "label": np.repeat([s[1] for s in sums], SUBSETS),
                                    "subset": np.tile(np.arange(SUBSETS), len(sums)), "n": np.concatenate([s[2] for s in sums])})

    added = every.mapInPandas(add, "part string, label int, subset int, n long")
    return added.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def _report(part: str, n: np.ndarray) -> pd.DataFrame:
    """The audit of one part; ``n[label, subset]`` are its survivors."""
    k = len(FILTERS)
    rows, every = [], SUBSETS - 1
    failing = [int(n[0, 0] - n[0, 1 << f]) for f in range(k)]
    unique = [int(n[0, every ^ (1 << f)] - n[0, every]) for f in range(k)]
    # a filter meets the subset S of others before it in |S|! (k - 1 - |S|)! of the orders
    shapley = [sum(math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) * int(n[0, s] - n[0, s | 1 << f])
                   for s in range(SUBSETS) if not s >> f & 1) for f in range(k)]
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in n[:, before] - n[:, after])
            rows.append((part, "".join(FILTERS[i] for i in order), step, int(n[0, after]), removed, failing[f] - removed,
                         unique[f], good, toxic, shapley[f]))
            before = after
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley"])


def interactions(counts: DataFrame) -> DataFrame:
    """The audit from ``survivors``: one row per part, order of the filters and step, 600 for each part."""
    tables = counts.groupBy("part").agg(F.map_from_entries(   # at most 96 entries
        F.collect_list(F.struct(F.col("label") * SUBSETS + F.col("subset"), "n"))).alias("n"))
    dense = tables.select("part", F.transform(F.sequence(F.lit(0), F.lit(len(LABELS) * SUBSETS - 1)),
                                              lambda i: F.coalesce(F.try_element_at("n", i), F.lit(0).cast("long"))).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, n in zip(b["part"], b["n"]):
                yield _report(part, np.asarray(n, np.int64).reshape(len(LABELS), SUBSETS))

    return dense.mapInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                  "unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; see the module text."""
    return interactions(survivors(checked(docs, part_col), labels))


def audit_sql() -> str:
    """The same audit in DuckDB SQL, by applying the filters document by document."""
    letters = "(values ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""
        with texts as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
        failed as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                   (case when len(w) < 50 then 'A' else '' end)
                   || (case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end)
                   || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end)
                   || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
                   || (case when texts.doc_id > min(texts.doc_id) over (partition by t) then 'E' else '' end) as fails
            from texts left join marks using (doc_id)),
        kinds as (select part, fails, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
                  from failed group by part, fails),
        orders as (select a.l || b.l || c.l || d.l || e.l as filter_order
                   from {letters} a(l), {letters} b(l), {letters} c(l), {letters} d(l), {letters} e(l)
                   where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l),
        steps as (select filter_order, cast(s as integer) as step, substr(filter_order, s, 1) as f,
                         left(filter_order, s - 1) as before, left(filter_order, s) as after
                  from orders, (values (1), (2), (3), (4), (5)) x(s)),
        counted as (
            select part, filter_order, step, f,
                   sum(n) filter (translate(fails, after, '') = fails) as kept,
                   sum(n) filter (contains(fails, f) and translate(fails, before, '') = fails) as removed,
                   sum(n) filter (contains(fails, f) and translate(fails, before, '') <> fails) as redundant,
                   sum(n) filter (fails = f) as unique_fails,
                   sum(n_good) filter (contains(fails, f) and translate(fails, before, '') = fails) as good_lost,
                   sum(n_toxic) filter (contains(fails, f) and translate(fails, before, '') = fails) as toxic_lost
            from kinds, steps group by part, filter_order, step, f)
        select part, filter_order, step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in (
            "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
               cast(coalesce(sum(removed) over (partition by part, f), 0) as bigint) as shapley
        from counted
    """
