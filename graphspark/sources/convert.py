"""Conversions between graph file formats: read one, write another."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph, dedup, symmetrize
from graphspark.session import measured
from graphspark.sources import readers, writers


def bipartite(ratings, users: int) -> Graph:
    """A bipartite graph of (u, i, r): items are numbered after the users."""
    return Graph.of(ratings.select(F.col("u").alias("src"), (F.col("i") + users).alias("dst"), F.col("r").alias("weight")), None, True)


def convert(spark: SparkSession, source: str, target: str, src_fmt: str, dst_fmt: str, **options) -> None:
    """Targets: mtx, el (0-based), sel (both directions), cel (src < dst once), sadj (label and neighbours), adj (degree and
    neighbours), ctxt (labelled lines), labels, bip (bipartite edge list of a ratings file)."""
    if dst_fmt == "bip":
        size = [int(x) for x in readers._first_line(spark, source, "%")]
        writers.write_el(bipartite(readers.read_ratings_mtx(spark, source), size[0]), target)
        return
    g = readers.load_graph(spark, source, src_fmt, **options)

    def both() -> Graph:
        edges, found = measured(g.edges, "edges")
        return Graph(dedup(symmetrize(edges), 2 * found["n"]), g.vertices, False)

    if dst_fmt == "mtx":
        writers.write_mtx(g, target)
    elif dst_fmt == "el":
        writers.write_el(g, target)
    elif dst_fmt == "sel":
        writers.write_el(both(), target)
    elif dst_fmt == "cel":
        writers.write_el(Graph(writers.canonical_edges(g), g.vertices, True), target)
    elif dst_fmt == "sadj":
        writers.write_adjacency(both(), target)
    elif dst_fmt == "adj":
        writers.write_adjacency(g, target, label=False, degree=True)
    elif dst_fmt == "ctxt":
        writers.write_labelled(both(), target)
    elif dst_fmt == "labels":
        writers.write_labels(g, target)
    else:
        raise ValueError(f"unknown target format {dst_fmt}")
