"""Algebra of sorted vertex sets, as array expressions and as joins.

The array forms work on neighbour arrays of one row; the join forms take tables of
(key, v) and are what to use when neighbourhoods are large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersection(a, b, below=None) -> Column:
    """Elements of both; with ``below``, only those less than it."""
    out = F.array_intersect(a, b)
    return out if below is None else F.filter(out, lambda x: x < below)


def intersection_count(a, b, below=None, without: list | None = None) -> Column:
    """How many elements both have, less than ``below`` and other than those of ``without``."""
    out = intersection(a, b, below)
    return F.size(F.array_except(out, F.array(*without))) if without else F.size(out)


def difference(a, b, also=None, below=None) -> Column:
    """Elements of a that b lacks and that aren't ``also`` (b's own vertex), less than ``below``."""
    out = F.array_except(a, b if also is None else F.array_append(b, also))
    return out if below is None else F.filter(out, lambda x: x < below)


def difference_count(a, b, also=None, below=None) -> Column:
    return F.size(difference(a, b, also, below))


def bounded(a, below) -> Column:
    """The prefix of elements less than ``below``."""
    return F.filter(a, lambda x: x < below)


def union(a, b) -> Column:
    return F.array_sort(F.array_union(a, b))


def contains(a, v) -> Column:
    return F.array_contains(a, v)


def neighbors_in_common(pairs: DataFrame, edges: DataFrame, below: str | None = None) -> DataFrame:
    """(a, b, v): common neighbours of pairs(a, b), by joins; ``below`` names a column that bounds v."""
    e1 = edges.select(F.col("src").alias("a"), F.col("dst").alias("v"))
    e2 = edges.select(F.col("src").alias("b"), F.col("dst").alias("v"))
    out = pairs.join(e1, "a").join(e2, ["b", "v"], "left_semi")
    return (out if below is None else out.where(F.col("v") < F.col(below))).select("a", "b", "v")


def neighbors_not_shared(pairs: DataFrame, edges: DataFrame, below: str | None = None) -> DataFrame:
    """(a, b, v): neighbours of a that are neither b nor neighbours of b."""
    e1 = edges.select(F.col("src").alias("a"), F.col("dst").alias("v"))
    e2 = edges.select(F.col("src").alias("b"), F.col("dst").alias("v"))
    out = pairs.join(e1, "a").where("v <> b").join(e2, ["b", "v"], "left_anti")
    return (out if below is None else out.where(F.col("v") < F.col(below))).select("a", "b", "v")


def connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs(a, b) that are edges."""
    return pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi")


def labelled_common_count(pairs: DataFrame, edges: DataFrame, vertices: DataFrame, label: int) -> DataFrame:
    """(a, b, n): common neighbours with a label; pairs without any have no row."""
    of = vertices.where(F.col("label") == label).select("v")
    return neighbors_in_common(pairs, edges).join(of, "v", "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
