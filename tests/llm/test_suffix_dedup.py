import random
from collections import Counter

import numpy as np
import pytest

from linkfold.llm import suffix_dedup as X

from corpus import SCHEMA, edge_rows, random_rows, table


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        cut = np.zeros(len(d) + 1, int)
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                cut[i] += 1
                cut[i + window] -= 1
        gone = np.cumsum(cut[:-1]) > 0
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(d), tuple(zip(spans[::2].tolist(), spans[1::2].tolist())), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def texts(seed):
    """Few letters, shared passages at many places, near copies, runs of one letter, umlauts."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abé ", k=rng.randint(15, 120))) for _ in range(6)]
    out = []
    for _ in range(70):
        t = "".join(rng.choice(["".join(rng.choices("abcdefgh é", k=rng.randint(0, 50))), rng.choice(passages), "a" * rng.randint(0, 60)])
                    for _ in range(rng.randint(0, 6)))
        out.append(t)
        if t and rng.random() < 0.3:
            i = rng.randrange(len(t))
            out.append(t[:i] + rng.choice("xyz") + t[i + rng.randint(0, 2):])
    return out + [None, "", "short", out[3], out[3]]


def check(spark, rows, **options):
    got = X.remove_repeats(table(spark, rows), **options).collect()
    have = Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got)
    assert have == Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], options.get("window", 200))))


@pytest.mark.parametrize("window,key,group_runs", [(20, 8, 5000), (20, 8, 1), (33, 5, 5000), (16, 16, 5000), (17, 1, 3)])
def test_against_brute_force(spark, window, key, group_runs):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts(window))]
    check(spark, rows, window=window, key=key, group_runs=group_runs)


def test_odd_rows_with_the_default_window(spark):
    rows = [r if r[1] is None or len(r[1]) < 10_000 else (*r[:1], r[1][-7000:], *r[2:]) for r in edge_rows()]
    check(spark, rows + [(1000 + r[0], *r[1:]) for r in random_rows(60, words=150)])


def test_many_equal_rows(spark):
    check(spark, [(7, "a passage that all of them share", "en", "s", 0)] * 300 + [(8, "and a passage that all of them have", "en", "s", 0)] * 2, window=20, key=8)


def test_chunks_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 50)
    lengths = np.array([0, 5, 20, 19, 49, 50, 69, 70, 500, 21])
    starts = Counter((i, p) for part in X._chunks(lengths, 20) for i, s, e in part for p in range(s, e - 19))
    assert starts == Counter((i, p) for i, n in enumerate(lengths.tolist()) for p in range(n - 19))


def test_radix_sort_against_grouping():
    rng = random.Random(8)
    data = [bytes(rng.choices(b"ab", k=rng.randint(20, 40))) for _ in range(60)]
    h, place = np.sort(np.array([rng.randrange(4) for _ in data])), np.array([rng.randrange(3) for _ in data])
    seen = Counter((int(h[r]), int(place[r]) - i, d[i:i + 20]) for r, d in enumerate(data) for i in range(len(d) - 19))
    want = {(r, i) for r, d in enumerate(data) for i in range(len(d) - 19) if seen[int(h[r]), int(place[r]) - i, d[i:i + 20]] > 1}
    run, rel = X.equal_windows(h, place, data, 20)
    assert set(zip(run.tolist(), rel.tolist())) == want and len(run) == len(want)


def test_empty_table(spark):
    assert X.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
