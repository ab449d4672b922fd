"""Sparse matrix-vector product and symmetric Gauss-Seidel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.session import loop_materialize, materialize


def spmv(g: Graph, x: DataFrame, y: DataFrame | None = None, weight: float | None = None) -> DataFrame:
    """(v, value): y plus, for each vertex, the sum of weight * x over its in-edges; ``weight`` stands in for the edges' own."""
    w = F.lit(weight) if weight is not None else F.col("weight").cast("double")
    into = g.edges.join(x.select(F.col("v").alias("src"), F.col("value").alias("xv")), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(w * F.col("xv")).alias("s"))
    out = g.vertices.select("v").join(into, "v", "left")
    if y is None:
        return out.select("v", F.coalesce("s", F.lit(0.0)).alias("value"))
    return out.join(y.select("v", F.col("value").alias("y0")), "v", "left").select("v", (F.coalesce("y0", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("value"))


def symmetric_gauss_seidel(matrix: DataFrame, diagonal: DataFrame, b: DataFrame, colors: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(v, value) after a sweep over the colors upwards and one downwards.

    ``matrix(row, col, value)`` without the diagonal, ``diagonal(v, value)``, ``b(v, value)``,
    ``colors(v, color)``. Rows of one color are updated together; a row with a zero diagonal keeps its x.
    """
    paths: list[str] = []
    rows = materialize(
        colors.select("v", "color").join(diagonal.select("v", F.col("value").alias("d")), "v", "left").join(b.select("v", F.col("value").alias("b")), "v", "left").select("v", "color", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("b", F.lit(0.0)).alias("b")), "gs-rows"
    )
    entries = materialize(matrix.where("row <> col").join(rows.select(F.col("v").alias("row"), "color"), "row").select("row", "col", "value", "color"), "gs-matrix")
    start = x.select("v", F.col("value")) if x is not None else rows.select("v", F.lit(0.0).alias("value"))
    state = loop_materialize(start, "gs", paths)
    order = [r[0] for r in rows.select("color").distinct().orderBy("color").collect()]  # as many as colors
    for c in order + order[::-1]:
        s = entries.where(F.col("color") == c).join(state.select(F.col("v").alias("col"), F.col("value").alias("xv")), "col").groupBy(F.col("row").alias("v")).agg(F.sum(F.col("value") * F.col("xv")).alias("s"))
        new = rows.where((F.col("color") == c) & (F.col("d") != 0)).join(s, "v", "left").select("v", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("new"))
        state = loop_materialize(state.join(new, "v", "left").select("v", F.coalesce("new", "value").alias("value")), "gs", paths)
    return state


def residual(matrix: DataFrame, diagonal: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """(v, value): b - A x by row."""
    s = matrix.where("row <> col").join(x.select(F.col("v").alias("col"), F.col("value").alias("xv")), "col").groupBy(F.col("row").alias("v")).agg(F.sum(F.col("value") * F.col("xv")).alias("s"))
    d = diagonal.select("v", F.col("value").alias("d")).join(x.select("v", F.col("value").alias("xv")), "v")
    return b.select("v", F.col("value").alias("b")).join(d, "v").join(s, "v", "left").select("v", (F.col("b") - F.col("d") * F.col("xv") - F.coalesce("s", F.lit(0.0))).alias("value"))


def max_relative_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(error): the largest |a - b| / (|a| + |b| + eps) over vertices."""
    return a.select("v", F.col("value").alias("x")).join(b.select("v", F.col("value").alias("y")), "v").agg(F.max(F.abs(F.col("x") - F.col("y")) / (F.abs("x") + F.abs("y") + F.lit(2.220446049250313e-16))).alias("error"))


def l2_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(error): the Euclidean distance of two vectors."""
    return a.select("v", F.col("value").alias("x")).join(b.select("v", F.col("value").alias("y")), "v").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("error"))
