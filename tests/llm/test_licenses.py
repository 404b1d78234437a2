import math
import random
import re
from collections import Counter

import duckdb
import pytest

from linkfold.llm import licenses as L

from corpus import EDGE_TEXTS, SCHEMA, edge_rows, table

NOTICE = L.TEMPLATES[9][1] if L.TEMPLATES[9][0] == "mit" else next(t for _, t in L.TEMPLATES if t.startswith("Permission"))
FILL = "some other words that stand around the notice and belong to nobody at all " * 9
LICENSES = [
    "x " * 30 + "Licensed under the\nApache License, Version 2.0.", "this is cc-by-nc and CC BY NC again, cc by", "under the MIT license " * 3,
    FILL + NOTICE.replace(" ", "\n") + FILL, FILL + NOTICE.replace("granted", "given") + FILL, NOTICE.replace("free of charge, to any", "") + FILL,
    " ".join(sorted(NOTICE.split())), "Licensed under CC BY 4.0", "All rights reserved", "rights reserved", "ALL RIGHTS RESERVED" * 2,
    "under the Kmit license", "\u212ait UNDER THE MIT LICENSE", "UNDER THE M\u0130T LICENSE \u0130", "\u212a cc by nc", "under themit license", "GNU General Public License version 3 licensed under the", "a " * 31 + "mit",
]


def bodies():
    """Whole license texts: alone, amid much else at many places, with a few words changed, cut in half, and torn apart by other words."""
    out = []
    for _, t in L.BODIES:
        w, other = t.split(), [f"w{i}" for i in range(900)]
        out += [t, *(" ".join([*other[:k], *w, *other[k:]]) for k in range(0, 900, 131)), t.replace("IMPLIED", "tacit").replace("Software", "Work"),
                " ".join(w[:len(w) // 2]), " ".join([*w[:len(w) // 2], *other, *w[len(w) // 2:]])]
    return out


def rows():
    return edge_rows() + [(500 + i, t, "en", "s", len(t)) for i, t in enumerate(LICENSES + bodies())]


def brute(text, threshold=0.9, span=32):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(L.WORD, lower)
    places = [(i, label) for label, p in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    base = set(labels)
    for label, t in L.TEMPLATES:
        tokens, n = set(L.template_words(t)), len(re.findall(L.WORD, t.lower()))
        wide = next(span << k for k in range(30) if n <= (span << k) + 1)
        for b in range(max(0, len(w) - wide - 1) // wide + 1):
            block = set(w[b * wide:(b + 2) * wide])
            if len(tokens & block) >= math.ceil(threshold * len(tokens)):
                labels.add(label)
                score = max(score, len(tokens & block) / len(tokens))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def test_against_brute_force(spark):
    data = rows()
    got = L.scan_licenses(table(spark, data)).collect()
    want = Counter((r[0], *brute(r[1])) for r in data)
    assert Counter((*tuple(r)[:7], round(r["score"], 9)) for r in got) == want
    assert any("mit" in k[6] and not k[5] for k in want)     # the method finds blocks that no phrase stands in


def test_against_sql(spark):
    import pandas as pd
    data = rows()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in data], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.execute(L.scan_sql()).fetchall()
    got = L.scan_licenses(table(spark, data)).collect()
    key = lambda rows: Counter((*tuple(r)[:7], round(r[7], 9)) for r in rows)
    assert key(got) == key(want)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_thresholds(spark, threshold):
    data = rows()
    got = L.scan_licenses(table(spark, data), threshold=threshold).collect()
    assert Counter((r["doc_id"], r["labels"]) for r in got) == Counter((r[0], brute(r[1], threshold)[5]) for r in data)


def test_native_plan(spark):
    plan = L.scan_licenses(table(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_whole_license_texts_are_found(spark):
    assert len(re.findall(L.WORD, L.BODIES[1][1].lower())) > 160
    texts = bodies()
    got = {r["doc_id"]: r for r in L.scan_licenses(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), templates=L.BODIES).collect()}
    half = len(texts) // 2
    for start, (label, _) in zip((0, half), L.BODIES):
        whole, (changed, cut, torn) = range(start, start + half - 3), range(start + half - 3, start + half)
        assert all((got[i]["labels"], got[i]["score"]) == (label, 1.0) for i in whole)
        assert got[changed]["labels"] == label and 0.9 <= got[changed]["score"] < 1
        assert not got[cut]["labels"] and not got[torn]["labels"]


def test_the_prefix_index_leads_to_every_template_held(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(25)]
    needs = [(str(k), sorted(rng.sample(words, n)), math.ceil(share * n), 32)
             for k, (n, share) in enumerate([(1, 1.0), (3, 0.5), (8, 0.9), (8, 0.6), (20, 0.8), (25, 0.3)] * 6)]
    held = [rng.sample(words, rng.randint(0, 25)) for _ in range(400)] + [[]]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(held)], "i int, held array<string>").select(
        "i", L.holds_enough("held", needs[1:]).alias("ok"), L.holds_enough("held", needs[4:6]).alias("few"), L.holds_enough("held", []).alias("none"))
    enough = lambda h, some: any(len({*h} & {*tokens}) >= need for _, tokens, need, _ in some)
    for r in got.collect():
        assert (r["ok"], r["few"], r["none"]) == (enough(held[r["i"]], needs[1:]), enough(held[r["i"]], needs[4:6]), False)
    index = L.prefix_index(L._needs(L.TEMPLATES, 0.9, 32))
    every = {t for _, text in L.TEMPLATES for t in L.template_words(text)}
    assert len(index) < len(every) / 2 and "the" not in index


def test_bad_templates(spark):
    with pytest.raises(ValueError):
        L.scan_licenses(table(spark, rows()), templates=[("x", " .,-")])


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == [] and EDGE_TEXTS
