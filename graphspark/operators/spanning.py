"""Minimum spanning forest by Boruvka rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.connectivity import _union, component_labels
from graphspark.session import loop_materialize, materialize, measured, release


def minimum_spanning_forest(g: Graph) -> DataFrame:
    """(src, dst, weight), src < dst: the forest of the symmetrized graph; equal weights are ordered by (src, dst)."""
    both = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst")
    edges = materialize(both.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "mst-edges")
    paths: list[str] = []
    comp = loop_materialize(g.vertices.select("v", F.col("v").alias("c")), "mst", paths)
    chosen: list[DataFrame] = []
    while True:
        a, b = comp.select(F.col("v").alias("src"), F.col("c").alias("a")), comp.select(F.col("v").alias("dst"), F.col("c").alias("b"))
        across = edges.join(a, "src").join(b, "dst").where("a <> b").select("a", "b", F.struct("weight", "src", "dst").alias("e"))
        least = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b"), "e")).groupBy("a").agg(F.min(F.struct("e", "b")).alias("m"))
        picked, size = measured(least.select("a", F.col("m.b").alias("b"), F.col("m.e.*")), "mst-picked")
        if not size["n"]:
            return _union(chosen) if chosen else edges.limit(0)
        chosen.append(materialize(picked.select("src", "dst", "weight").distinct(), "mst-chosen"))
        merged = component_labels(picked.select("a", "b"))
        comp = loop_materialize(comp.join(merged, F.col("c") == F.col("node"), "left").select("v", F.coalesce("label", "c").alias("c")), "mst", paths)
        release(picked)


def forest_summary(g: Graph, forest: DataFrame | None = None) -> DataFrame:
    """(weight, edges, components) of the minimum spanning forest."""
    forest = minimum_spanning_forest(g) if forest is None else forest
    n = g.vertices.agg(F.count("*").alias("n"))
    return forest.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count("*").alias("edges")).crossJoin(n).select("weight", "edges", (F.col("n") - F.col("edges")).alias("components"))
