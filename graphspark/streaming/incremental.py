"""Incremental connected components over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.operators.connectivity import component_labels
from graphspark.session import loop_materialize


class IncrementalComponents:
    """Keeps (v, component) over micro-batches of edges: a batch's edges are contracted to components so far, whose own
    components relabel the table. Use ``update`` as the function of ``foreachBatch``; a batch that is run again changes
    nothing, as components are the same whichever edges repeat."""

    def __init__(self) -> None:
        self.labels: DataFrame | None = None
        self._paths: list[str] = []

    def update(self, edges: DataFrame, epoch: int = 0) -> None:
        ends = edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()
        if self.labels is None:
            old = ends.select("v", F.col("v").alias("component"))
        else:
            old = self.labels.unionByName(ends.join(self.labels, "v", "left_anti").select("v", F.col("v").alias("component")))
        a, b = old.select(F.col("v").alias("src"), F.col("component").alias("a")), old.select(F.col("v").alias("dst"), F.col("component").alias("b"))
        merged = component_labels(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a <> b").select("a", "b"))
        self.labels = loop_materialize(old.join(merged, F.col("component") == F.col("node"), "left").select("v", F.coalesce("label", "component").alias("component")), "stream-cc", self._paths)


def stream_components(edges: DataFrame, state: IncrementalComponents, checkpoint: str):
    """Starts the query that keeps ``state`` up to date with a streaming DataFrame of edges(src, dst)."""
    return edges.writeStream.foreachBatch(state.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_degrees(edges: DataFrame) -> DataFrame:
    """(v, degree): out-degrees of a stream of edges, kept by Spark's own state; for output mode complete or update."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
