import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkfold.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

from corpus import SCHEMA, edge_rows, random_rows, table


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"hot_count": 1, "salts": 3}, {"digest": lambda t: F.substring(F.md5(t), 1, 1)},
                                     {"digest": lambda t: F.lit("same"), "hot_count": 2, "salts": 2}])
def test_against_brute_force(spark, options):
    rows = edge_rows() + [(1000 + r[0], *r[1:]) for r in random_rows(80)]
    got = exact_duplicates(table(spark, rows), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_dropping_keeps_whole_rows(spark):
    rows = edge_rows()
    docs = table(spark, rows)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert Counter((r["text"] or "") for r in out.collect()) == Counter({r[1] or "" for r in rows})


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert drop_exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
