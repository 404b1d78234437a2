"""Reports over a component membership table ``(node, component)`` without root rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.operators.ordering import chunked_lists

MEMBER_CHUNK = 1024  # ids per member-list row: a list never holds more than this


def nonroot_counts(membership: DataFrame) -> DataFrame:
    """``(component, n_nonroot)`` largest first: the size report of the analysed code."""
    return (membership.groupBy("component").agg(F.count(F.lit(1)).alias("n_nonroot"))
            .orderBy(F.desc("n_nonroot"), "component"))


def component_sizes(membership: DataFrame) -> DataFrame:
    """``(component, n_nodes)``: non-root rows plus the root."""
    return membership.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("n_nodes"))


def top_components(membership: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` largest components, ties broken by the smaller component id."""
    return component_sizes(membership).orderBy(F.desc("n_nodes"), "component").limit(k)


def component_count(membership: DataFrame) -> DataFrame:
    """Number of components with at least two nodes."""
    return membership.agg(F.countDistinct("component").alias("n_components"))


def nonroot_count(membership: DataFrame) -> DataFrame:
    """Number of non-root rows: what the analysed code logs as its component count."""
    return membership.agg(F.count(F.lit(1)).alias("n_nonroot"))


def with_roots(membership: DataFrame) -> DataFrame:
    roots = membership.select(F.col("component").alias("node"), "component").distinct()
    return membership.select("node", "component").union(roots)


def component_members(membership: DataFrame, chunk: int = MEMBER_CHUNK) -> DataFrame:
    """Sorted member lists, root included, in rows of at most ``chunk`` ids of any type.

    ``(component, chunk, members)``: a component's members in order, ``chunk`` of them to a row, so a component of up to
    ``chunk`` members is one whole list; ``members`` is comma-joined.
    """
    lists = chunked_lists(with_roots(membership), "component", "node", "members", chunk)
    return lists.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))
