"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF0001
from linkfold.sources.edges import DRIVER_TABLES
from linkfold.storage import checkpoint_root, scratch

QUERIES = {k: f for k, f in entry.queries().items() if k not in entry.LLM_QUERIES}   # those have tests of their own
SQL = {k: s for k, s in entry.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def _types(cols, rows):
    return {c: {type(r[i]).__name__ for r in rows if r[i] is not None} for i, c in enumerate(cols)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def _tables(spark):
    """Paths in the session's checkpoint folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().toString() for f in fs.listStatus(root)} if fs.exists(root) else set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    before = _tables(spark)
    with scratch(spark, keep=True) as owned:
        df = QUERIES[name](spark, SF0001)
        srows = [tuple(r) for r in df.collect()]
    owned.release()
    assert _tables(spark) == before   # nothing is left behind
    res = con.execute(SQL[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert _canon(df.columns, srows) == _canon(ocols, orows)
    assert _types(df.columns, srows) == _types(ocols, orows)   # 1 == True == Decimal(1)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["component", "n_nodes"]
    assert df.count() > 0
