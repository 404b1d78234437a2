"""Token ids of whole texts by the ``tokenizers`` library, inside a task.

The vocabulary's tokenizer cuts a text into pre-tokens before it merges, so the library encodes each different
pre-token once and a bounded table keeps what it gave: a few times faster than whole texts, where every
word is merged anew. Texts with a special string, or with letters outside those listed here, go to the library whole.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

#: characters of text that are encoded together
BATCH_CHARS = 1_500_000
#: strings that a worker keeps per tokenizer (about 150 MB); the first ones stay, as frequent ones come early
CACHE_ENTRIES = 700_000


@functools.cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


#: fixed values: the byte-level pattern of the tokenizer file, for text whose letters and digits are those below
_LETTER, _DIGIT = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\u024f]*")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next free one."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@contextlib.contextmanager
def collector_off():
    """Millions of strings and no cycles: Python's cycle collector would only walk the tables again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memory:
    """What ``learn`` gives for strings; the first ``entries`` of them are kept."""

    def __init__(self, learn, entries: int):
        self.learn, self.entries, self.known = learn, entries, {}

    def of(self, strings: set[str]) -> dict:
        """A table of ``strings`` alone: small enough for a processor's cache, unlike what is kept."""
        known = self.known
        here = {s: known[s] for s in strings if s in known}
        new = [s for s in strings if s not in here]
        learnt = dict(zip(new, self.learn(new)))
        if len(known) < self.entries:
            known.update(learnt)
        here.update(learnt)
        return here


def by_size(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``chars`` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class PreTokenIds(dict):
    """Ids of each pre-token, by the library's model alone: nothing is left to normalise or to split. The first ``entries`` that
    are asked for stay; one look-up serves a pre-token, and the entries of frequent ones lie in the processor's cache."""

    def __init__(self, tok, entries: int):
        super().__init__()
        self.merge, self.letters, self.entries = tok.model.tokenize, byte_letters(), entries

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))]
        data = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.entries:
            self[word] = data
        return data


class ByteBpeEncoder:
    """Ids of whole texts under a byte-level BPE tokenizer, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tok, self.special = load(path), special_strings(path)
        self.words = PreTokenIds(self.tok, entries)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        with collector_off():
            return [b"".join(map(self.words.__getitem__, _PRE_TOKEN.findall(t)))
                    if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else self._whole([t])[0] for t in texts]


@functools.cache
def byte_bpe(path: str) -> ByteBpeEncoder:
    return ByteBpeEncoder(path)
