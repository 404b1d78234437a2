"""Vector maths on ``array<double>`` columns, as built-in higher-order expressions
(JVM-side, inside whole-stage code generation; no Python on the data path)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_distance(a, b) -> Column:
    """Sum of squared element differences (``^`` would be XOR in Spark SQL)."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def euclidean_distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def vector_add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def vector_scale(a, divisor) -> Column:
    """Element-wise ``a / divisor``."""
    d = _col(divisor) if not isinstance(divisor, (int, float)) else F.lit(float(divisor))
    return F.transform(_col(a), lambda x: x / d)


CENTERS_TYPE = "array<struct<cid:int,center:array<double>>>"


def centers_json(centers: list[tuple[int, list[float]]]) -> str:
    return json.dumps([{"cid": int(c), "center": [float(v) for v in vec]} for c, vec in centers])


def centers_sql(centers: list[tuple[int, list[float]]] | None = None, param: str | None = None) -> str:
    """SQL for the ``array<struct<cid int, center array<double>>>`` constant of a few
    centroids: one JSON string (inline, or bound to the named parameter ``param``) that
    constant folding parses once at planning time, so the plan carries a single array
    literal whatever ``k`` and the dimension."""
    src = f":{param}" if param else "'" + centers_json(centers) + "'"
    return f"from_json({src}, '{CENTERS_TYPE}')"


def centers_literal(centers: list[tuple[int, list[float]]]) -> Column:
    return F.expr(centers_sql(centers))


def checked_sql(features: str, dims: int) -> str:
    """SQL that gives ``features`` if it is a vector of ``dims`` elements and ends the run otherwise: a shorter or
    longer vector has no distance to the centroids."""
    return (f"if(size({features}) = {int(dims)}, {features}, raise_error(concat('a vector has ', "
            f"coalesce(cast(size({features}) as string), 'no'), ' elements, not {int(dims)}')))")


def distance_sql(features: str, center: str) -> str:
    return f"sqrt(aggregate(zip_with({features}, {center}, (x, y) -> (x - y) * (x - y)), 0D, (a, v) -> a + v))"


def _keyed_sql(features: str, dims: int, centers: list[tuple[int, list[float]]] | None, digits: int, param: str | None) -> str:
    """``array<struct<key, cid, dist>>``: every centroid with its distance and the distance rounded, which is what is compared."""
    dist = distance_sql(checked_sql(f"`{features}`", dims), "c.center")
    return (f"transform(transform({centers_sql(centers, param)}, "
            f"c -> named_struct('cid', c.cid, 'dist', {dist})), "
            f"d -> named_struct('key', round(d.dist, {digits}), 'cid', d.cid, 'dist', d.dist))")


def nearest_sql(features: str, dims: int, centers: list[tuple[int, list[float]]] | None = None,
                digits: int = 9, param: str | None = None) -> str:
    """SQL text of ``nearest`` over the column named ``features``.

    The centroids come inline or, with ``param``, from a named query parameter holding
    their JSON, so the text of a step is the same whatever the centroids are."""
    return f"array_min({_keyed_sql(features, dims, centers, digits, param)})"


def ranked_sql(features: str, dims: int, digits: int = 9, param: str | None = None) -> str:
    """The same as an array of all centroids, the nearest first."""
    return f"array_sort({_keyed_sql(features, dims, None, digits, param)})"


def nearest(features: str, centers: list[tuple[int, list[float]]], digits: int = 9) -> Column:
    """``struct<key, cid, dist>`` of the closest centroid. Distances are compared rounded
    to ``digits`` places and ties go to the lowest ``cid``, so the winner does not depend
    on summation order. One form for every size of input."""
    return F.expr(nearest_sql(features, len(centers[0][1]) if centers else 0, centers, digits))


def distances_to(features, centers: list[tuple[int, list[float]]]) -> Column:
    """``array<struct<cid, dist>>``: distance to every centroid (k entries per row)."""
    checked = F.expr(checked_sql(f"`{features}`", len(centers[0][1]) if centers else 0))
    return F.transform(centers_literal(centers), lambda c: F.struct(
        c["cid"].alias("cid"), euclidean_distance(checked, c["center"]).alias("dist")))
