import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkfold.llm import packing, rans
from linkfold.llm.token_counts import ShortcutCounter, count_tokens
from linkfold.llm.tokens import ByteBpeEncoder

from corpus import EDGE_TEXTS, SCHEMA, edge_rows, random_rows, table

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "The", "É", "é", "é", "İ", "ß", "'s", "'", "1", "23", "½", "ª", "<|endoftext|>", "<|", "　",
         "\x1c", "\x85", "\xa0", "日本", "😀", "Σ", "ſ", "​", "\0", "don't", "…", ".", "!!", "ﬁ", "Å", "Å", "᠎", "﻿"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(4000)] + [t or "" for t in EDGE_TEXTS]


def test_ids_as_the_library_gives_them(odd_texts):
    lib = Tokenizer.from_file(BYTE)
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(odd_texts, add_special_tokens=False)]
    assert ByteBpeEncoder(BYTE).encode(odd_texts) == want
    full = ByteBpeEncoder(BYTE, entries=10)   # a memory that is full at once
    assert full.encode(odd_texts[:500]) + full.encode(odd_texts[500:]) == want


def test_counts_as_the_library_gives_them(odd_texts):
    lib = Tokenizer.from_file(WORD)
    want = [len(e.ids) for e in lib.encode_batch(odd_texts, add_special_tokens=False)]
    assert ShortcutCounter(WORD).count(odd_texts) == want
    assert ShortcutCounter(WORD, entries=10).count(odd_texts) == want


def test_proved_words_encode_alone():
    whole = ShortcutCounter(WORD).whole
    assert len(whole) > 20_000 and {"the", "license", "é"} <= whole
    lib = Tokenizer.from_file(WORD)
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 2000))


def test_count_tokens(spark):
    rows = edge_rows()
    lib = Tokenizer.from_file(WORD)
    n = [len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    want = Counter((r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(rows, n))
    assert Counter(tuple(r) for r in count_tokens(table(spark, rows), WORD).collect()) == want
    assert count_tokens(spark.createDataFrame([], SCHEMA), WORD).collect() == []


# ---------------------------------------------------------------- packing

def test_best_fit_never_overfills_and_fills_well():
    rng = random.Random(2)
    fills = [rng.randint(1, 100) for _ in range(3000)] + [100] * 5
    bins = packing.best_fit(fills, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(fills)))
    assert all(sum(fills[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= sum(fills) / 100 * 1.02 + 1


@pytest.mark.parametrize("partitions,fan_in,group_items", [(3, 8, 200_000), (9, 2, 200_000), (4, 2, 7)])
def test_pack_documents(spark, partitions, fan_in, group_items):
    rows = edge_rows() + [(1000 + r[0], *r[1:]) for r in random_rows(200)]
    lib = Tokenizer.from_file(BYTE)
    want = []
    for r in rows:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        want += [(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(table(spark, rows, partitions=partitions), BYTE, capacity=64, slack=1, fan_in=fan_in,
                                 group_items=group_items).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= sum(x[3] for x in want) / 64 * 1.02 + 2 + (group_items < 10) * 30


def test_packed_sequences_hold_the_ids(spark):
    rows = random_rows(60)
    docs = table(spark, rows)
    from linkfold.llm.common import numbered
    pieces = numbered(packing.token_pieces(docs, BYTE, capacity=32), "test-pieces", "piece_row")
    layout = packing.pack(pieces, capacity=32)
    whole = {r["sequence_id"]: (r["length"], bytes(r["ids"])) for r in packing.packed_sequences(pieces, layout).collect()}
    ids = {r["piece_row"]: bytes(r["ids"]) for r in pieces.collect()}
    for r in layout.collect():
        mine = ids[r["piece_row"]]
        length, data = whole[r["sequence_id"]]
        assert length <= 32 and len(data) == 4 * length
        assert data[4 * r["offset"]:4 * r["offset"] + len(mine)] == mine


def test_goes_of_one_partition_are_merged(spark):
    from linkfold.llm.common import numbered
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        pieces = numbered(spark.range(0, 1000, 1, 1).selectExpr("if(id % 50 = 7, 5L, 64L) as length"), "test-goes", "piece_row")
        layout = packing.pack(pieces, capacity=64, slack=1, group_items=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["piece_row"] for r in layout) == sorted(r["piece_row"] for r in pieces.collect())
    # 20 short pieces, two in each of ten goes, fill two sequences
    assert len({r["sequence_id"] for r in layout}) == 980 + 2


def test_packing_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), BYTE).collect() == []


# ---------------------------------------------------------------- rANS

@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70_000), st.integers(1, 50_000), st.integers(0, 2**32 - 1), st.floats(0.0, 3.0))
def test_block_round_trip(n, symbols, seed, skew):
    rng = np.random.default_rng(seed)
    ids = (rng.random(n) ** (1 + skew) * symbols).astype("<u4")
    table = rans.Table.from_bytes(rans.Table.of(ids).to_bytes())
    assert (rans.decode_block(rans.encode_block(ids, table), table) == ids).all()


def test_blocks_decode_alone_from_any_checkpoint_and_reject_damage():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 2_500_000) % 50_000).astype("<u4")
    row = rans.segment_row(0, 0, [7], [ids.tobytes()])
    table = rans.Table.from_bytes(row["table"])
    parts = [rans.decode_block(b, table) for b in row["blocks"][::-1]][::-1]
    assert len(parts) == -(-len(ids) // rans.BLOCK) and (np.concatenate(parts) == ids).all()
    block, lanes = row["blocks"][1], row["blocks"][1]["lanes"]
    points = -(-(-(-block["n"] // lanes)) // rans.EVERY)
    head = np.frombuffer(block["checkpoints"], "<u8")
    at, states = head[:points].astype(np.int64), head[points:].reshape(points, lanes)
    words = np.frombuffer(block["payload"], "<u4").astype(np.uint64)
    some = rans._decode_runs(states[2:3], at[2:3], words, 1000, table)[0]
    first = rans.BLOCK + 2 * rans.EVERY * lanes
    assert points > 2 and (some == ids[first:first + 1000]).all()
    size = len(row["table"]) + sum(len(b["payload"]) + len(b["checkpoints"]) for b in row["blocks"])
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert size < 1.15 * entropy + len(row["table"])
    bad = block | {"payload": bytes([block["payload"][0] ^ 1]) + block["payload"][1:]}
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(bad, table)


@pytest.mark.parametrize("segment_tokens", [50, 1 << 21])
def test_token_files(spark, tmp_path, segment_tokens):
    rows = [r for r in edge_rows() if r[1] is None or len(r[1]) < 1000] + [(1000 + r[0], *r[1:]) for r in random_rows(100)]
    lib = Tokenizer.from_file(BYTE)
    rans.write_token_files(table(spark, rows, partitions=5), f"{tmp_path}/f", BYTE, end_id=2, segment_tokens=segment_tokens)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, at = [], 0
    for r in order:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert Counter(tuple(r) for r in rans.token_index(spark, f"{tmp_path}/f").collect()) == Counter(want)
    whole = rans.read_token_files(spark, f"{tmp_path}/f").collect()
    assert Counter((r["doc_id"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in whole) == Counter((d, n, c) for d, _, n, c in want)


def test_token_files_keep_ids(spark, tmp_path):
    big = (1 << 53) + 1
    docs = table(spark, [(big, "a", "en", "s", 1), (None, "b", "en", "s", 1), (big + 1, "c", "en", "s", 1)], partitions=1)
    rans.write_token_files(docs, f"{tmp_path}/f", BYTE, end_id=2)
    assert [r["doc_id"] for r in rans.token_index(spark, f"{tmp_path}/f").orderBy("start").collect()] == [None, big, big + 1]
    rans.write_token_files(docs.selectExpr("concat('k', doc_id) as doc_id", "text"), f"{tmp_path}/g", BYTE, end_id=2)
    assert [r["doc_id"] for r in rans.token_index(spark, f"{tmp_path}/g", "string").orderBy("start").collect()] == [
        None, f"k{big}", f"k{big + 1}"]


def test_token_files_of_nothing(spark, tmp_path):
    rans.write_token_files(spark.createDataFrame([], SCHEMA), f"{tmp_path}/f", BYTE, end_id=2)
    assert rans.token_index(spark, f"{tmp_path}/f").collect() == []
