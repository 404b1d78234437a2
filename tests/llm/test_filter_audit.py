import random
import re
from itertools import permutations

import numpy as np

from linkfold.llm.filter_audit import WORDS, audit_filters, checked, failed_filters, positional_popcount, word_counts

from corpus import SCHEMA, edge_rows, random_rows, table

LABELS = "doc_id long, quality int, toxic int"


def plain_failures(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        out.append({f for f in fails if fails[f]})
    return out


def plain_audit(rows, labels):
    failed, want = plain_failures(rows), set()
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {r[3] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, failed) if (r[3] or "") == part]
        table, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                table.append((part, "".join(order), step, f, len(left) - len(gone), len(gone), sum(f in d[1] for d in docs) - len(gone),
                              sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
        want |= {(*t[:3], *t[4:], shapley[t[3]]) for t in table}
    return want


def varied_rows(n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "GAMMA", f"w{rng.randrange(500)}", f"x{rng.randrange(9)}"]) for _ in range(rng.randint(20, 120))]
        if rng.random() < 0.2:
            words.append("#tag")
        rows.append((i, rng.choice(rows)[1] if rows and rng.random() < 0.3 else rng.choice([" ", "\n"]).join(words), "en",
                     f"s{rng.randrange(3)}", 1))
    return rows


def test_popcounts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 100, 4097):
        w = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert positional_popcount(w).tolist() == [int(((w >> b) & 1).sum()) for b in range(32)]


def test_survival_words():
    for failed in range(32):
        assert [int(WORDS[failed]) >> s & 1 for s in range(32)] == [int(not s & failed) for s in range(32)]


def test_words_across_slabs():
    for text in (b"a b " * 400_000, b"x" * 3_000_000, b" " * 2_500_000, b"w" * (1 << 20) + b" w", b"ab" + b" cd" * 700_000 + b"\n"):
        assert word_counts(text) == (len(text.split()), len(set(text.split())))


def test_every_filter_on_odd_texts(spark):
    rows = edge_rows()
    assert [failed_filters((r[1] or "").encode()) for r in rows] == [
        sum(1 << "ABCD".index(f) for f in fails if f != "E") for fails in plain_failures(rows)]
    got = sorted((str(r["doc_id"]), r["part"], r["failed"]) for r in checked(table(spark, rows)).collect())
    assert got == sorted((str(r[0]), r[3] or "", sum(1 << "ABCDE".index(f) for f in fails)) for r, fails in zip(rows, plain_failures(rows)))


def test_audit_against_the_filters_one_by_one(spark):
    rows = edge_rows() + [(1000 + r[0], *r[1:]) for r in varied_rows()] + random_rows(40)
    rng = random.Random(2)
    labels = [(r[0], rng.randrange(2), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.5]
    labels += [(None, 1, 1), (1005, 1, 0), (1005, 0, 1), (99999, 1, 1)]
    got = audit_filters(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert {tuple(r) for r in got} == plain_audit(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], LABELS)
    assert audit_filters(none, no_labels).collect() == []
    rows = varied_rows(20)
    assert {tuple(r) for r in audit_filters(table(spark, rows), no_labels).collect()} == plain_audit(rows, [])
