"""Whole-column reductions and elementwise vector arithmetic, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.session import spread


def l1_distance(a: str, b: str) -> Column:
    return F.sum(F.abs(F.col(a) - F.col(b)))


def l2_distance(a: str, b: str) -> Column:
    return F.sqrt(F.sum((F.col(a) - F.col(b)) ** 2))


def root_mean_square(error: str) -> Column:
    return F.sqrt(F.sum(F.col(error) * F.col(error)) / F.count("*"))


def max_relative_error(a: str, b: str) -> Column:
    return F.max(F.abs(F.col(a) - F.col(b)) / (F.abs(F.col(a)) + F.abs(F.col(b)) + F.lit(2.220446049250313e-16)))


def mode(df: DataFrame, column: str) -> DataFrame:
    """(value, n): the most frequent value, the least of equals; counted exactly."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)


def saxpy(a: float, x: str, y: str) -> Column:
    return F.lit(a) * F.col(x) + F.col(y)


def vec_add(x: str, y: str) -> Column:
    return F.col(x) + F.col(y)


def vec_mul(x: str, y: str) -> Column:
    return F.col(x) * F.col(y)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of the product of two matrices in coordinates.

    A row of ``b`` goes to each row of ``a`` that has its number, as one array; products are made and added up where the row of
    the result is, in as many tasks as their number asks for.
    """
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    lines = b.groupBy(F.col("row").alias("k")).agg(F.collect_list(F.struct("col", F.col("value").alias("y"))).alias("line"))
    uses = left.groupBy("k").agg(F.count("*").alias("uses")).join(b.groupBy(F.col("row").alias("k")).agg(F.count("*").alias("n")), "k")
    products = uses.agg(F.sum(F.col("uses") * F.col("n"))).first()[0] or 0
    terms = spread(left.join(lines, "k").select("row", "x", "line"), products, "row").select("row", "x", F.explode("line").alias("t"))
    return terms.groupBy("row", F.col("t.col").alias("col")).agg(F.sum(F.col("x") * F.col("t.y")).alias("value"))


def laplace_step(grid: DataFrame) -> DataFrame:
    """(row, col, value): each inner cell of a grid becomes the mean of its four neighbours; the border stays."""
    near = [F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    sent = grid.select(F.explode(F.array(*near)).alias("to"), "value").select("to.*", "value").groupBy("row", "col").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return grid.join(sent, ["row", "col"], "left").select("row", "col", F.when(F.col("n") == 4, F.col("s") / 4).otherwise(F.col("value")).alias("value"))
