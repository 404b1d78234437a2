"""Pair (edge) operators: the map side of a component round and the small pieces the
analysed code composes rounds from.

A pair table has two id columns, ``n1`` and ``n2`` by default. Ids keep the column's own
type, so the order that decides the component root is Spark's order for that type:
numeric for integral ids, byte-wise (lexical) for strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_pairs(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rename an edge table to ``(n1, n2)``; rows with a null id carry no edge and go."""
    return (df.select(F.col(src).alias("n1"), F.col(dst).alias("n2"))
            .where(F.col("n1").isNotNull() & F.col("n2").isNotNull()))


def reverse_pairs(df: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """Swap the two columns, keeping their names."""
    return df.select(F.col(b).alias(a), F.col(a).alias(b))


def mirror_union(df: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """Bag union by position of the pairs and their reverses (a narrow union)."""
    return df.select(a, b).union(reverse_pairs(df, a, b))


def _pair_struct(a: str, b: str, first: str, second: str) -> str:
    """SQL for a ``struct<a, b>`` holding columns ``first`` and ``second``."""
    return f"named_struct('{a}', `{first}`, '{b}', `{second}`)"


def mirror_explode(df: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """Both directions of every row in one pass: one row in, two rows out."""
    fwd, back = _pair_struct(a, b, a, b), _pair_struct(a, b, b, a)
    return df.selectExpr(f"inline(array({fwd}, {back}))")


def mirror_distinct(df: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """Set union of the pairs and their reverses (the map step under set semantics).

    Each pair is de-duplicated once, whichever way round it came, and mirrored afterwards: the hash tables of the
    de-duplication, which are the largest memory of a task, and its shuffle hold one row for every two that leave. A null id is the least."""
    swap = f"`{a}` > `{b}` or (`{b}` is null and `{a}` is not null)"
    once = df.selectExpr(f"if({swap}, `{b}`, `{a}`) as `{a}`", f"if({swap}, `{a}`, `{b}`) as `{b}`").distinct()
    return mirror_canonical(once, a, b)


def canonical_pairs(df: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """Each undirected edge once as ``(least, greatest)``; a self-loop stays ``(x, x)``."""
    return df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def mirror_canonical(df: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """The mirrored set of a canonical pair table in one scan: equal to
    ``mirror_distinct`` of the original edges (a self-loop appears once)."""
    fwd, back = _pair_struct(a, b, a, b), _pair_struct(a, b, b, a)
    return df.selectExpr(f"inline(if(`{a}` <=> `{b}`, array({fwd}), array({fwd}, {back})))")


def dedup_pairs(df: DataFrame) -> DataFrame:
    """Distinct rows (partial de-duplication before the shuffle, final after it)."""
    return df.distinct()


def distinct_nodes(df: DataFrame, a: str = "n1", b: str = "n2", out: str = "node") -> DataFrame:
    """Every id that occurs on either side of a pair."""
    return df.select(F.col(a).alias(out)).union(df.select(F.col(b).alias(out))).distinct()


def relabel_case(key: Column, mn: Column, value: Column) -> Column:
    """The new first id of an emitted pair: the key itself where the value is the
    minimum (that row becomes ``(key, min)``), else the value."""
    return F.when(value == mn, key).otherwise(value)


def relabel_ordered(key: Column, mn: Column, value: Column) -> Column:
    """The ordered variant: the value where the minimum is below it, else the key."""
    return F.when(mn < value, value).otherwise(key)
