"""Language ID by rank-order profiles of character n-grams.

A language's profile is the ranking of its ``profile_size`` most frequent n-grams (1 to ``max_n`` letters, words set off by a
space). A text's own ranking is compared with each profile: the out-of-place distance adds up, over the text's n-grams, how
far each stands from its place in the profile, and ``profile_size`` for one that the profile lacks. The least distance wins.

``train`` counts n-grams on a bounded sample: about ``docs_per_lang`` labelled documents of each language, drawn by a hash of the
id. It sees only text and language. Profiles (languages times ``profile_size`` rows; at most ``max_langs`` languages) go to the
driver and to every task.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn
from; equal distances go to the first language by code point; n-grams of equal counts rank by their code points (profile) or
hash (text); ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkfold.llm.common import boxed, stored, text_or_empty

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18   # characters that are counted at a time


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def spaced_letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters than letters, and each end, is one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp > 0xFFFF):
        letter[i] = chr(cp[i]).isalpha()
    cp = np.where(letter, cp, 32)
    cp = np.concatenate([[32], cp, [32]]).astype(np.uint64)
    return cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]


def grams(cp: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(n, starts, hashes)`` of the n-grams that hold a letter and no space but at their ends."""
    space = cp == 32
    h = np.zeros(len(cp), np.uint64)
    inner = np.zeros(len(cp), bool)   # a space strictly inside
    for n in range(1, max_n + 1):
        m = len(cp) - n + 1
        if m <= 0:
            return
        if n > 2:
            inner = inner[:m] | space[n - 2:n - 2 + m]
        h = (h[:m] + cp[n - 1:n - 1 + m] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        ok = ~space[:m] if n == 1 else ~inner[:m]
        at = np.flatnonzero(ok)
        yield n, at, h[at]


def text_ranking(text: str, size: int, max_n: int) -> np.ndarray:
    """Hashes of a whole text's most frequent n-grams, most frequent first."""
    cp = spaced_letters(text)
    if len(cp) < 3:
        return np.zeros(0, np.uint64)
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = max(1, _PIECE)
    for s in range(0, len(cp), step):   # pieces overlap by max_n - 1, and an n-gram counts where it starts
        piece = cp[s:s + step + max_n - 1]
        h = np.concatenate([x[at < step] for _, at, x in grams(piece, max_n)])
        u, c = np.unique(h, return_counts=True)
        if len(found):
            u, inv = np.unique(np.concatenate([found, u]), return_inverse=True)
            c = np.bincount(inv, np.concatenate([counts, c])).astype(np.int64)
        found, counts = u, c
    if len(found) > size:   # only those that can be among the first need sorting
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.argsort(-counts, kind="stable")][:size]


def gram_hash(gram: str) -> int:
    """The hash that ``grams`` gives to an n-gram."""
    cp = np.array([ord(c) for c in gram], np.uint64)
    h = np.zeros(1, np.uint64)
    for c in cp:
        h = (h + c + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return int(h[0])


@dataclass
class Model:
    langs: list[str]
    hashes: np.ndarray    # all profiles' n-grams, sorted
    ranks: np.ndarray     # languages x n-grams; profile_size where a profile lacks it
    size: int
    max_n: int

    @classmethod
    def of(cls, profiles: dict[str, list[str]], size: int, max_n: int) -> Model:
        langs = sorted(profiles)
        hashes = np.unique(np.array([gram_hash(g) for p in profiles.values() for g in p], np.uint64))
        ranks = np.full((len(langs), len(hashes)), size, np.int64)
        for k, lang in enumerate(langs):
            at = np.searchsorted(hashes, np.array([gram_hash(g) for g in profiles[lang]], np.uint64))
            ranks[k, at] = np.arange(len(at))
        return cls(langs, hashes, ranks, size, max_n)

    def predict(self, text: str) -> tuple[str, float]:
        """The language and, as score, 1 - distance / greatest possible distance."""
        mine = text_ranking(text, self.size, self.max_n)
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
        known = self.hashes[at] == mine
        place = np.arange(len(mine))
        theirs = self.ranks[:, at]
        apart = np.where(known & (theirs < self.size), np.abs(theirs - place), self.size).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(mine)))


def train(docs: DataFrame, profile_size: int = 400, max_n: int = 5, docs_per_lang: int = 1500, max_langs: int = 1000,
          seed: int = 42) -> Model:
    """Profiles from ``docs(doc_id, text, lang)``; rows without a language are left out. ``doc_id`` only draws the sample."""
    rows = docs.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)).alias("_draw"))
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "langid-sizes")
    if sizes.count() > max_langs:
        raise ValueError(f"more than max_langs={max_langs} languages")
    share = sizes.select("lang", (F.lit(docs_per_lang) / F.col("_n") * (1 << 30)).alias("_below"))
    sample = rows.join(F.broadcast(share), "lang").where("_draw < _below").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                for i in range(0, len(part), 200):   # bounded arrays; the sums are Spark's
                    cps = [spaced_letters(t) for t in part["text"].iloc[i:i + 200]]
                    cp = np.concatenate(cps)          # each ends and begins with a space, so no n-gram spans two texts
                    for n, at, h in grams(cp, max_n):
                        if not len(h):   # a frame without rows has no types
                            continue
                        _, first, c = np.unique(h, return_index=True, return_counts=True)
                        starts = at[first]
                        chars = cp.astype("<u4")[starts[:, None] + np.arange(n)]
                        names = [chars[k].tobytes().decode("utf-32-le") for k in range(len(chars))]
                        yield pd.DataFrame({"lang": lang, "gram": names, "n": c})

    sums = sample.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = (sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
           .where(F.col("rank") <= profile_size))
    profiles: dict[str, list[str]] = {}
    for row in sorted(top.select("lang", "gram", "rank").collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return Model.of(profiles, profile_size, max_n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the ``text`` column alone (columns of those names are replaced)."""
    keep = docs.drop("lang_pred", "score")
    text_at = keep.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t or "") for t in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType())]))


def held_out() -> Column:
    """Documents that training leaves out: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the documents that are not held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs.where(~held_out()), **options)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def known_language(docs: DataFrame, min_score: float = 0.0, **options) -> DataFrame:
    """``docs`` without those that language ID rejects: no letter at all, or a score below ``min_score``. Columns that
    happen to be named like the prediction's stay as they are."""
    named = predict(boxed(docs).select("row", "text"), train(docs.where(~held_out()), **options))
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
