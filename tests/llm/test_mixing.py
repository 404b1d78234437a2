import random
import struct

import pytest
import xxhash

from linkfold.llm.mixing import mix_sources, mixed_documents

from corpus import SCHEMA, edge_rows, random_rows, table


def words(text):
    return len((text or "").encode().split())


def targets(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + words(r[1])
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = share * sum(size.values()), set()
    while len(full) < len(order):
        level = (goal - sum(cap * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] >= cap * size[s]}
        if not more:
            break
        full |= more
    return {s: cap * size[s] if s in full else level * weight[s] for s in order}, size


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_targets_and_words_taken(spark, block):
    rows = edge_rows() + [(1000 + r[0], *r[1:]) for r in random_rows(150)]
    rows = [r if words(r[1]) < 5000 else (*r[:1], "short now", *r[2:]) for r in rows]
    mix = mix_sources(table(spark, rows), block=block, max_buckets=8)
    want, size = targets(rows)
    out = mix.documents.collect()
    assert len(out) == len(rows)
    for s in want:
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.5 + 1e-9
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    pieces = mix.pieces.collect()
    assert len({(r["sid"], r["block"]) for r in pieces}) == len({r["slot"] for r in pieces}) or block == 1
    per_block = {}
    for r in pieces:
        assert 0 <= r["from_word"] < r["to_word"]
        per_block[r["sid"], r["block"]] = per_block.get((r["sid"], r["block"]), 0) + r["to_word"] - r["from_word"]
    last = {}
    for s, b in per_block:
        last[s] = max(last.get(s, 0), b)
    assert all(n == block for (s, b), n in per_block.items() if b < last[s])   # equal blocks, but each source's last


def test_schedule_is_even_from_the_start(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 4}", 100) for i in range(400)]
    mix = mix_sources(table(spark, rows), block=50)
    want, _ = targets(rows)
    slots = sorted({(r["slot"], r["sid"]) for r in mix.pieces.collect()})[:100]
    share = [w / sum(want.values()) for _, w in sorted(want.items())]
    for sid, p in enumerate(share):
        assert abs(sum(1 for _, s in slots if s == sid) - 100 * p) <= 4   # low discrepancy


def test_reruns_agree(spark):
    rows = random_rows(120)
    def run(parts):
        return sorted(tuple(r)[1:] for r in mix_sources(table(spark, rows, partitions=parts)).documents.collect())
    assert run(2) == run(5)


def test_reruns_agree_with_null_and_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, None, 1, 2, 3, 4, 5, 6, 7]), "w" * rng.randint(1, 3) + " x" * rng.randint(0, 40) + f" t{rng.randrange(300)}", "en",
             rng.choice(["s1", "s2", "s3"]), 1) for _ in range(400)] + [(3, "the same", "en", "s1", 1)] * 60
    def run(parts):
        out = mix_sources(table(spark, rows, partitions=parts), block=16).documents
        return sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["first_slot"]), r["n_blocks"]) for r in out.collect())
    first = run(2)
    assert first == run(5) == run(7)


@pytest.mark.parametrize("block", [7, 64])
def test_words_taken_of_every_document(spark, block):
    """The streams laid out in plain Python: the order of the hash, then the target's words from the front, pass by pass."""
    rows = random_rows(150)
    want, (target, size) = {}, targets(rows)
    signed = lambda h: struct.unpack("<q", struct.pack("<Q", h))[0]
    for s in target:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: signed(
            xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42))))
        left = round(target[s])
        for r in mine * 2:
            n = min(left, words(r[1]))
            left -= n
            want[r[0]] = want.get(r[0], 0) + n
    got = {r["doc_id"]: r["taken"] for r in mix_sources(table(spark, rows), block=block).documents.collect()}
    assert got == want


def test_a_parquet_scan_is_not_copied(spark, tmp_path):
    from linkfold.storage import scratch
    table(spark, random_rows(60)).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with scratch(spark, keep=True) as owned:
        n = mixed_documents(docs).count()
        stored = [c for p in owned.paths for c in spark.read.parquet(p).columns]
    owned.release()
    assert n > 60 and not {"row", "text", "lang"} & set(stored)


def test_mixed_documents_are_whole_rows(spark):
    rows = edge_rows()
    docs = table(spark, rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {r[1] for r in rows}
    assert all(r["text"] in texts and words(r["text"]) for r in out.collect())


def test_documents_are_in_the_order_of_their_slots(spark):
    rows = [(i, f"d{i} " * 50, "en", f"s{i % 4}", 100) for i in range(400)]
    docs = table(spark, rows)
    mix = mix_sources(docs, block=50)
    first, blocks = {}, {}
    for r in mix.pieces.collect():
        first.setdefault((r["doc_id"], r["pass"]), []).append((r["slot"], r["at"]))
        blocks[r["doc_id"]] = blocks.get(r["doc_id"], 0) + 1
    begin = {k: min(v) for k, v in first.items()}
    taken = {}
    for r in mix.documents.collect():
        slots = [s for (d, _), (s, _) in begin.items() if d == r["doc_id"]]
        assert (r["first_slot"], r["n_blocks"]) == (min(slots, default=None), blocks.get(r["doc_id"], 0))
        taken[r["doc_id"]] = round(r["taken"] / r["size"])
    want = [d for (d, k), _ in sorted(begin.items(), key=lambda x: x[1]) if k < taken[d]]
    got = [r["doc_id"] for r in mixed_documents(docs, block=50).collect()]
    assert got == want and len(got) == 600


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix_sources(none).documents.collect() == []
    assert mixed_documents(none).collect() == []
