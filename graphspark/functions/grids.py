"""Small dense matrices in array columns, and a heat step on a grid in coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_product(a: str, b: str, n: int) -> Column:
    """Product of two n x n matrices, flat arrays row by row."""
    def cell(at: Column) -> Column:
        row, col = F.floor(at / n).cast("int"), (at % n).cast("int")
        terms = F.sequence(F.lit(0), F.lit(n - 1))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda total, k: total + F.get(a, row * n + k) * F.get(b, k * n + col))

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)


def trace(a: str, n: int) -> Column:
    """Sum of the diagonal of a flat n x n matrix."""
    return sum((F.get(a, F.lit(i * (n + 1))) for i in range(1, n)), F.get(a, F.lit(0)))


def characteristic_polynomial(df: DataFrame, matrix: str, n: int) -> DataFrame:
    """Adds ``c0`` .. ``c{n}``, the coefficients of det(x I - A) of a column of flat n x n matrices of longs (c{n} is 1).

    By Newton's identities from the traces of the powers of A. A row's matrix never leaves the row, so nothing is shuffled.
    """
    keep = df.columns
    out = df.withColumn("__m1", F.col(matrix))
    for k in range(2, n + 1):
        out = out.withColumn(f"__m{k}", matrix_product(f"__m{k - 1}", matrix, n))
    out = out.select(*keep, *(trace(f"__m{k}", n).alias(f"__p{k}") for k in range(1, n + 1)), F.lit(1).cast("long").alias(f"c{n}"))
    for k in range(1, n + 1):
        total = sum((F.col(f"c{n - k + i}") * F.col(f"__p{i}") for i in range(2, k + 1)), F.col(f"c{n - k + 1}") * F.col("__p1"))
        out = out.withColumn(f"c{n - k}", (-total / k).cast("long"))
    return out.select(*keep, *(f"c{k}" for k in range(n + 1)))


#: Fixed values of the thermal model: a silicon chip of 16 x 16 x 0.5 mm.
CHIP = {"side": 0.016, "thickness": 0.0005, "capacitance_factor": 0.5, "specific_heat": 1.75e6, "conductivity": 100.0, "max_power_density": 3.0e6, "precision": 0.001}


def chip_constants(rows: int, cols: int) -> tuple[float, float, float, float]:
    """(step over capacity, resistances along columns, along rows, to the outside) of a cell of a grid on the chip."""
    height, width = CHIP["side"] / rows, CHIP["side"] / cols
    heat = CHIP["capacitance_factor"] * CHIP["thickness"] * CHIP["specific_heat"]
    step = CHIP["precision"] / (CHIP["max_power_density"] / heat)
    along = 2.0 * CHIP["conductivity"] * CHIP["thickness"]
    return step / (heat * width * height), width / (along * height), height / (along * width), CHIP["thickness"] / (CHIP["conductivity"] * height * width)


def hotspot_step(grid: DataFrame, over_cap: float, rx: float, ry: float, rz: float, ambient: float = 80.0) -> DataFrame:
    """(row, col, temp, power) after one step of heat flow: a cell takes its power and what flows from its neighbours in its
    column (ry), its row (rx) and from outside (rz); at the border a missing neighbour is as warm as the cell."""
    near = [F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.lit(i != 0).alias("upright")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    sent = grid.select(F.explode(F.array(*near)).alias("to"), "temp").select("to.*", "temp")
    sums = sent.groupBy("row", "col").agg(
        *(F.coalesce(F.sum(F.when(F.col("upright") == up, F.col("temp"))), F.lit(0.0)).alias(f"s_{name}") for name, up in (("y", True), ("x", False))),
        *(F.count(F.when(F.col("upright") == up, 1)).alias(f"n_{name}") for name, up in (("y", True), ("x", False))),
    )
    flow = {name: F.coalesce(F.col(f"s_{name}"), F.lit(0.0)) - F.coalesce(F.col(f"n_{name}"), F.lit(0)) * F.col("temp") for name in ("x", "y")}
    warmer = F.col("power") + flow["y"] / ry + flow["x"] / rx + (F.lit(ambient) - F.col("temp")) / rz
    return grid.join(sums, ["row", "col"], "left").select("row", "col", (F.col("temp") + F.lit(over_cap) * warmer).alias("temp"), "power")
