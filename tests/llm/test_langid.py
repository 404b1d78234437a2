import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold.llm import langid
from linkfold.llm.common import read_documents

from corpus import CLASHING, LONG, SCHEMA, edge_rows, table


def brute_grams(text, max_n):
    word = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for w in word.split():
        w = f" {w} "
        for n in range(1, max_n + 1):
            out.update(g for g in (w[i:i + n] for i in range(len(w) - n + 1)) if g != " ")
    return out


@pytest.mark.parametrize("text", ["Hello, World! hello", "日本語 のテキスト 😀𝔸𝔹 x", "ab " * 50 + "é1é", LONG[:3000]])
def test_rankings_count_every_gram(text, monkeypatch):
    want = brute_grams(text, 5)
    for piece in (1 << 18, 7):
        monkeypatch.setattr(langid, "_PIECE", piece)
        top = langid.text_ranking(text, 10**6, 5)
        counts = {langid.gram_hash(g): n for g, n in want.items()}
        assert len(counts) == len(want) == len(top) and set(top.tolist()) == set(counts)
        found = [counts[h] for h in top.tolist()]
        assert found == sorted(found, reverse=True)


def test_distance_by_hand():
    model = langid.Model.of({"x": ["a", "b"], "y": ["b", " b"]}, 3, 2)
    # the text's n-grams rank by count, then hash
    mine = langid.text_ranking("b b b", 3, 2).tolist()
    names = {langid.gram_hash(g): g for g in ("b", " b", "b ")}
    ranking = [names[h] for h in mine]
    apart = {lang: sum(abs(p.index(g) - i) if g in p else 3 for i, g in enumerate(ranking))
             for lang, p in {"x": ["a", "b"], "y": ["b", " b"]}.items()}
    lang, score = model.predict("b b b")
    assert lang == min(apart, key=apart.get) and score == pytest.approx(1 - apart[lang] / 9)


def brute_identify(rows, size=400, max_n=5):
    """The whole operator in plain Python: profiles of all documents that are not held out, then the least out-of-place distance."""
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    counts = {}
    for r, out in zip(rows, held):
        if not out and r[2] is not None:
            counts.setdefault(r[2], Counter()).update(brute_grams(r[1] or "", max_n))
    profiles = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])} for lang, c in counts.items() if c}
    for r, out in zip(rows, held):
        ranked = sorted(brute_grams(r[1] or "", max_n).items(), key=lambda x: (-x[1], langid.gram_hash(x[0])))[:size]
        apart = {lang: sum(abs(p[g] - i) if g in p else size for i, (g, _) in enumerate(ranked)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=apart.get, default=None) if ranked else None
        yield (r[0], out, best or "und", round(1 - apart[best] / (size * len(ranked)), 9) if best else 0.0)


@pytest.mark.parametrize("options", [{}, {"profile_size": 50, "max_n": 3}])
def test_the_whole_operator_against_brute_force(spark, options):
    docs = read_documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    rows = [tuple(r) for r in docs.collect()] + [(10_000 + (r[0] or 0), *r[1:]) for r in edge_rows()]
    got = langid.identify(table(spark, rows), **options).collect()   # fewer documents of a language than the sample may hold
    want = Counter(brute_identify(rows, *options.values()))
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == want
    assert len({k[2] for k in want}) > 3


def test_held_out_accuracy(spark):
    docs = read_documents(spark, "/root/testdata/sf0.01")
    got = langid.identify(docs, docs_per_lang=60).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_lang_is_never_an_input_of_a_prediction(spark):
    docs = read_documents(spark, "/root/testdata/sf0.001")
    swapped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(swapped).collect())


def test_edges(spark):
    rows = edge_rows()
    got = langid.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    blank = {r[0] for r in rows if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    for r in got:
        if r["doc_id"] in blank:
            assert r["lang_pred"] == langid.UNKNOWN and r["score"] == 0
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de")
    docs = table(spark, rows)
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in r["text"]) for r in kept.collect())


def test_letters_too_short_for_long_grams(spark):
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in enumerate(["a", "b c", "", "!", "a"])], SCHEMA)
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} <= {"x", "und"}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none).collect() == [] and langid.known_language(none).collect() == []
    plain = spark.createDataFrame([(1, "text", None, "s", 4)], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(plain).collect()] == [("und", 0.0)]
    assert np.array_equal(langid.text_ranking("", 5, 5), np.zeros(0, np.uint64)) and "score" in CLASHING
