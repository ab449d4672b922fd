"""Synthetic graphs from hashes: the same seed gives the same graph on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph

#: Chances of the quadrants of a recursive matrix (fixed values of the Graph 500 benchmark); the fourth is what is left.
A, B, C = 0.57, 0.19, 0.19


def _draw(seed: int, *parts) -> Column:
    """Uniform in [0, 1) with 30 bits."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30)


def uniform_edges(spark: SparkSession, scale: int, degree: int = 16, seed: int = 0) -> DataFrame:
    """(src, dst): degree * 2**scale pairs of vertices drawn evenly from 2**scale."""
    n = 1 << scale
    end = lambda side: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(side)), F.lit(n))
    return spark.range(n * degree).select(end(0).alias("src"), end(1).alias("dst"))


def rmat_edges(spark: SparkSession, scale: int, degree: int = 16, seed: int = 0) -> DataFrame:
    """(src, dst) of a recursive matrix with permuted ids."""
    n = 1 << scale

    def level(state: Column, bit: Column) -> Column:
        r = _draw(seed, F.col("id"), bit)
        down, right = (r >= A + B).cast("long"), (((r >= A) & (r < A + B)) | (r >= A + B + C)).cast("long")
        return F.struct((state["s"] * 2 + down).alias("s"), (state["d"] * 2 + right).alias("d"))

    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("d"))
    raw = spark.range(n * degree).select(F.aggregate(F.sequence(F.lit(1), F.lit(scale)), zero, level).alias("e"))
    return raw.select(permuted(F.col("e.s"), scale, seed).alias("src"), permuted(F.col("e.d"), scale, seed).alias("dst"))


def permuted(v: Column, scale: int, seed: int = 0) -> Column:
    """A permutation of 0 .. 2**scale - 1: rounds of odd multiplication, xor shift and addition, each of which can be undone."""
    mask, half = (1 << scale) - 1, max(1, scale // 2)
    out = v
    for k in range(3):
        odd = (2654435761 + 2 * (seed * 40503 + k * 7919)) & mask | 1
        out = (out * F.lit(odd) + F.lit((seed + k) * 31 & mask)).bitwiseAND(F.lit(mask))
        out = out.bitwiseXOR(F.shiftright(out, half))
    return out


def generate(spark: SparkSession, scale: int, degree: int = 16, kind: str = "rmat", seed: int = 0, directed: bool = True) -> Graph:
    """A graph of 2**scale vertices; ``kind`` is rmat or uniform."""
    if kind not in ("rmat", "uniform"):
        raise ValueError(f"unknown kind {kind}")
    edges = (rmat_edges if kind == "rmat" else uniform_edges)(spark, scale, degree, seed)
    return Graph.of(edges, spark.range(1 << scale).select(F.col("id").alias("v")), directed)


def random_weights(edges: DataFrame, seed: int = 0, top: int = 255) -> DataFrame:
    """Whole weights 1..top by a hash of the edge, the same in both directions."""
    return edges.withColumn("weight", F.pmod(F.xxhash64(F.lit(seed), F.least("src", "dst"), F.greatest("src", "dst")), F.lit(top)) + 1)
