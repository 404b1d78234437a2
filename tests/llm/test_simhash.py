import inspect
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from linkfold.llm import simhash

from corpus import SCHEMA, edge_rows, random_rows, table


def brute_fingerprint(text, width):
    data = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) > width else \
        [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    a, parent = np.array(fps, "<u8"), list(range(len(fps)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= bits) + i + 1:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def clustered(n, seed, centres=20, flips=6):
    """Random fingerprints, many of them a few bits from one of some centres."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
    for i in range(0, n, 2):
        a[i] = a[2 * rng.integers(0, centres) + 1]
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            a[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(a)


@pytest.mark.parametrize("n,shard,small", [(3000, 200, 64), (3000, 10_000, 16), (500, 50, 8)])
def test_tree_finds_every_link(n, shard, small):
    a = clustered(n, n + shard)
    tree = simhash.fit_tree(a[::3], len(a), shard, 4, least=8)
    labels = np.arange(len(a))
    shards = {}
    for s, side, at in simhash.route(tree, a, 4):
        shards.setdefault(s, {})[side] = at
    assert len(shards) > 1 or shard >= n
    for sides in shards.values():
        simhash.link(a, sides.get(0, np.zeros(0, int)), None, 4, labels, small)
        simhash.link(a, sides.get(0, np.zeros(0, int)), sides.get(1, np.zeros(0, int)), 4, labels, small)
    assert labels.tolist() == brute_components(a, 4)


def test_every_pair_meets_in_exactly_one_shard():
    a = clustered(400, 7)
    tree = simhash.fit_tree(a, len(a), 60, 4, least=8)
    meet = np.zeros((len(a), len(a)), int)
    shards = {}
    for s, side, at in simhash.route(tree, a, 4):
        shards.setdefault(s, {})[side] = at
    for sides in shards.values():
        if 0 in sides:
            meet[np.ix_(sides[0], sides[0])] += 1
        if 0 in sides and 1 in sides:
            meet[np.ix_(sides[0], sides[1])] += 1
            meet[np.ix_(sides[1], sides[0])] += 1
    stored = np.concatenate([sides[0] for sides in shards.values() if 0 in sides])
    assert sorted(stored.tolist()) == list(range(len(a)))     # every point is stored once
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    np.fill_diagonal(near, False)
    assert (meet[near] == 1).all()


@pytest.mark.parametrize("options", [{}, {"shard": 20, "sample": 60}, {"shard": 50, "shard_cap": 10}, {"shard": 20, "shard_cap": 70}])
def test_links_in_spark(spark, options):
    a = clustered(600, 11)
    reps = spark.createDataFrame(pd.DataFrame({"fp": a.view("<i8"), "rep": np.arange(len(a))})).repartition(3)
    parent = np.arange(len(a))
    rows = simhash.near_links(reps, 4, **options).collect()
    for r in rows:
        simhash._join_labels(parent, np.array([r["a"]]), np.array([r["b"]]))
    assert parent.tolist() == brute_components(a, 4)


@pytest.mark.parametrize("bits", [4, 12])
def test_documents_against_brute_force(spark, bits):
    rows = edge_rows() + [(1000 + r[0], *r[1:]) for r in random_rows(150, words=200)]
    fps = [brute_fingerprint(r[1], 4) if len(r[1] or "") < 9999 else simhash.fingerprint(r[1].encode()) for r in rows]
    # rows that share an id are one document
    ids = [r[0] for r in rows]
    comp = brute_components(fps, bits)
    parent = {c: c for c in comp}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    seen = {}
    for i, c in zip(ids, comp):
        if i is not None and i in seen:
            parent[root(c)] = root(seen[i])
        seen[i] = c
    least = {}
    for i, c in zip(ids, comp):
        if i is not None:
            least[root(c)] = min(i, least.get(root(c), i))
    want = sorted((str(i), f"{f:016x}", str(least.get(root(c)))) for i, f, c in zip(ids, fps, comp))
    got = simhash.near_duplicates(table(spark, rows), max_bits=bits)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got.collect()) == want


def test_one_document_of_each_group_stays(spark):
    rows = edge_rows()
    docs = table(spark, rows)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == \
        sorted({r["component_id"] for r in found if r["component_id"] is not None})


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.drop_near_duplicates(none).collect() == []


def unlike(n, seed=5, words=60):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{w}" for w in rng.integers(0, 10**6, words)) for _ in range(n)]


def by_id(pairs):
    return sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))


def test_rows_with_null_and_repeated_ids_stay_apart(spark):
    t = unlike(10)
    rows = [(i, x, "en", "s", 1) for i, x in [
        (None, t[0]), (None, t[1]), (None, t[2]), (1, t[3]), (1, t[4]), (1, t[5]), (2, t[6]), (2, t[7]), (7, t[0]), (8, t[3]),
        (0, t[5]), (None, t[6]), (None, None), (9, t[8]), (9, t[8]), (None, t[9]), (None, t[9])]]
    groups = {}
    for r, c in zip(rows, brute_components([brute_fingerprint(r[1], 4) for r in rows], 4)):
        groups.setdefault(c, []).append((r[0], r[1] or ""))
    want = by_id(by_id(g)[0] for g in groups.values())
    out = corpus_pipeline.near(spark, table(spark, rows), "").collect()
    assert by_id((r["doc_id"], r["text"] or "") for r in out) == want and len(want) == 11


def test_null_ids_are_no_shared_id(spark):
    rows = [r for r in edge_rows() if r[0] is None]
    out = simhash.drop_near_duplicates(table(spark, rows)).collect()
    assert by_id((r["doc_id"], r["text"] or "") for r in out) == [(None, ""), (None, "a null id")]


def chain(bits):
    """Three texts, the first and the last more than ``bits`` apart, the middle one within ``bits`` of both."""
    apart = lambda x, y: bin(brute_fingerprint(x, 4) ^ brute_fingerprint(y, 4)).count("1")
    for seed in range(1000):
        words = unlike(1, seed, 300)[0].split()
        a, b, c = (" ".join(["new"] * k + words[k:300 - k] + ["end"] * k) for k in (0, 3, 6))
        if apart(a, b) <= bits and apart(b, c) <= bits < apart(a, c):
            return a, b, c
    raise AssertionError("no chain")


def test_a_text_with_a_null_id_links_two_others(spark):
    a, b, c = chain(4)
    far = unlike(3, 77)
    rows = [(i, x, "en", "s", 1) for i, x in [(5, a), (None, b), (3, c), (None, far[0]), (8, far[1]), (None, far[1]),
                                              (2, far[2]), (8, far[2])]]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    name = {f"{brute_fingerprint(x, 4):016x}": x for x in (a, b, c, *far)}
    assert sorted((name[r["fingerprint"]], str(r["doc_id"]), r["component_id"], r["class_size"]) for r in got) == sorted([
        (a, "5", 3, 1), (b, "None", 3, 1), (c, "3", 3, 1), (far[0], "None", None, 1), (far[1], "8", 2, 2),
        (far[1], "None", 2, 2), (far[2], "2", 2, 2), (far[2], "8", 2, 2)])   # id 8 has two texts: one document
    out = corpus_pipeline.near(spark, table(spark, rows), "").collect()
    assert by_id((r["doc_id"], r["text"]) for r in out) == [(2, far[2]), (3, c), (8, far[1]), (None, far[0])]


def test_default_shards_split_as_many_classes_as_a_small_input_has():
    default = inspect.signature(simhash.near_links).parameters
    a = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 50_000, np.uint64, endpoint=False))
    tree = simhash.fit_tree(a[:default["sample"].default], len(a), default["shard"].default, 4)
    assert len({shard for shard, _, _ in simhash.route(tree, a, 4)}) > 1   # no one task compares everything
