"""Token counts by the whole-token shortcut.

``prove_whole`` finds offline, from the vocabulary alone, the strings that are one pre-token and
that the library encodes as exactly one token. Counting a text then needs no merging for its pre-tokens among
these: each counts one. Only the other pre-tokens are merged by the library, and a
bounded table keeps their counts.

Works for tokenizers that lower-case, drop white space and split by words (``word_bpe_49k.json``). Texts in
which a special string occurs, whole or in part, go to the library whole.

Cases: null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from linkfold.llm.common import texts
from linkfold.llm.tokens import BATCH_CHARS, CACHE_ENTRIES, Memory, by_size, byte_letters, collector_off, load, special_strings

#: fixed values: the word pattern and word end of the tokenizer file
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


#: chunks that Python normalises and splits as the library does; all others go to the library
PLAIN = re.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]+")
#: white space that str.split() and the library may see differently
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")


def normal(chunk: str) -> str:
    return unicodedata.normalize("NFC", chunk).lower()


def prove_whole(path: str) -> frozenset[str]:
    """The strings ``w`` such that ``w`` is one pre-token, already normal, and encodes alone as one token."""
    tok, split = load(path), regex.compile(WORD_PATTERN)
    letters = {c: b for b, c in byte_letters().items()}
    words = []
    for v in tok.get_vocab():
        if v.endswith(WORD_END) and len(v) > len(WORD_END) and all(c in letters for c in v[:-len(WORD_END)]):
            w = bytes(letters[c] for c in v[:-len(WORD_END)]).decode("utf-8", "replace")
            if PLAIN.fullmatch(w) and normal(w) == w and split.findall(w) == [w]:
                words.append(w)
    return frozenset(w for w, e in zip(words, tok.encode_batch_fast(words, add_special_tokens=False))
                     if len(e.ids) == 1)


class ShortcutCounter:
    """Token counts of whole texts: the proved table, and bounded memories for what needs merging."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tok, self.split, self.special = load(path), regex.compile(WORD_PATTERN), special_strings(path)
        self.whole = prove_whole(path)
        self.merged = Memory(self._by_library, entries)    # pre-tokens that need merging
        self.chunks = Memory(self._by_shortcut, entries)   # strings between white space

    def _by_library(self, strings: list[str]) -> list[int]:
        return [len(e.ids) for i in range(0, len(strings), 2000)
                for e in self.tok.encode_batch_fast(strings[i:i + 2000], add_special_tokens=False)]

    def _by_shortcut(self, chunks: list[str]) -> list[int]:
        split = [self.split.findall(normal(c)) if PLAIN.fullmatch(c) else [c] for c in chunks]
        whole = self.whole
        merged = self.merged.of({w for ws in split for w in ws if w not in whole})
        return [sum(1 if w in whole else merged[w] for w in ws) for ws in split]

    def count(self, batch: list[str]) -> list[int]:
        with collector_off():
            return self._count(batch)

    def _count(self, batch: list[str]) -> list[int]:
        split = [None if ODD_SPACE.search(t) or any(s in t for s in self.special) else t.split() for t in batch]
        known = self.chunks.of(set().union(*(s for s in split if s is not None)))
        return [sum(map(known.__getitem__, s)) if s is not None
                else len(self.tok.encode(t, add_special_tokens=False).ids) for t, s in zip(batch, split)]


@functools.cache
def counter(path: str) -> ShortcutCounter:
    return ShortcutCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(tokenizer)
        for b in batches:
            every = b["text"].tolist()
            for i, j in by_size(every, BATCH_CHARS):
                text = every[i:j]
                n = c.count(text)
                yield pd.DataFrame({"doc_id": b["doc_id"].array[i:j],
                                    "n_bytes": [len(t.encode("utf-8")) for t in text],
                                    "n_tokens": n, "over_limit": [x > limit for x in n]})

    src = texts(docs)
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
