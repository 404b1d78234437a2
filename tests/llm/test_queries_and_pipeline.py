import hashlib
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from linkfold.llm import packing, queries, simhash
from linkfold.llm.common import read_documents, read_table

from corpus import SCHEMA, edge_rows, table
from test_mixing import targets, words
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.SQL) <= names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_cover_the_table(spark, name):
    got = entry.queries()[name](spark, SF)
    table, key = ("conversations", "conv_id") if name == "op12_conversation_repair" else ("documents", "doc_id")
    assert got.select(key).distinct().count() == read_table(spark, SF, table).select(key).distinct().count()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = read_documents(spark, SF)
    known = stages["language_id"](spark, docs, SF)
    assert known.count() == docs.count()                                    # clean documents stay
    single = stages["exact_dedup"](spark, known, SF)
    want = {}
    for r in docs.collect():
        want[r["text"]] = max(r["doc_id"], want.get(r["text"], -1))
    assert {r["text"]: r["doc_id"] for r in single.collect()} == want and single.count() == len(want)
    near = stages["simhash_near_dedup"](spark, single, SF)
    groups = simhash.near_duplicates(single).collect()
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in groups} and near.schema == docs.schema
    mixed = stages["source_mix"](spark, near, SF)
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.schema == docs.schema and max(taken.values()) == 2 and set(taken) <= {r["doc_id"] for r in near.collect()}
    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    pieces = packing.token_pieces(mixed, queries.BYTE_BPE).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == Counter((r["doc_id"], r["piece"], r["length"]) for r in pieces)


def test_run_is_the_stages_one_after_the_other(spark):
    out = corpus_pipeline.run(spark, SF)
    total = Counter()
    for r in out.collect():
        total[r["sequence_id"]] += r["length"]
    assert total and max(total.values()) <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, edge_rows())
    out = stage(spark, docs, SF)
    assert out.count() > 0
    if name != "best_fit_packing":
        assert out.columns == docs.columns
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_values_of_every_column(spark, name):
    """Also of columns named like those that the operators make, and with a dot in the name."""
    rows = [(i, f"some words of text number {i} " * 3 + "xyzzy"[:i % 5] * i, "en", f"s{i % 3}", 1) for i in range(40)]
    docs = table(spark, rows).selectExpr("*", "doc_id * 0.125 as `a.b`").drop("score", "lang_pred").selectExpr(
        "*", "doc_id / 8 as score", "concat('mine', doc_id) as lang_pred")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns and out.count() > 0
    want = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert all(want[r["doc_id"]] == tuple(r) for r in out.collect())


def plain_pipeline(rows):
    """The stages in plain Python. Rows with null or repeated ids are of a source that the mix takes whole, so ties in
    its shuffle do not matter."""
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    single = {}
    for r in rows:
        if r[1] not in single or (r[0] is not None and (single[r[1]][0] is None or r[0] > single[r[1]][0])):
            single[r[1]] = r
    rows, groups = list(single.values()), {}
    for r, c in zip(rows, brute_components([brute_fingerprint(r[1], 4) for r in rows], 4)):
        groups.setdefault(c, []).append(r)
    rows = [min(g, key=key) for g in groups.values()]
    want, size = targets(rows)
    mixed = []
    for source, target in want.items():
        mine, left = [r for r in rows if r[3] == source], round(target)
        if left == 2 * size[source]:
            mixed += mine * 2
            continue
        hashed = lambda r: xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42))
        for r in sorted(mine, key=lambda r: struct.unpack("<q", struct.pack("<Q", hashed(r)))) * 2:
            n = min(left, words(r[1]))
            left -= n
            mixed += [r] * (n > 0 and 2 * n >= words(r[1]))
    lib, out = Tokenizer.from_file(queries.BYTE_BPE), Counter()
    for r in mixed:
        ids = np.array([*lib.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        out.update((r[0], k, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return out, len(groups)


def test_run_against_plain_python(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(40)]
    text = lambda n=60: " ".join(rng.choices(vocab, k=n))
    rows = [(100 + i, text(), "en", "b", 1) for i in range(60)] + [(300, text(5000), "en", "b", 1)]
    rows += [(i, text(), "en", "a", 1) for i in (None, None, None, 1, 1, 1, 2, 2)]
    rows += [(i, rows[k][1], "en", "b", 1) for i, k in ((201, 3), (202, 3))] + [rows[61], rows[64]]
    rows += [(203, rows[4][1].upper(), "en", "b", 1), (None, rows[66][1].upper(), "en", "a", 1),
             (204, "123 456", "en", "b", 1), (205, None, "en", "b", 1), (None, "", "en", "a", 1)]
    want, documents = plain_pipeline(rows)
    assert documents == 69
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
