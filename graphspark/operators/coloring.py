"""Vertex coloring by rounds of local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph, out_degrees
from graphspark.session import dealt, loop_measured, materialize, release


def color(g: Graph) -> DataFrame:
    """(v, color) of an undirected graph, colors from 0: each round colors the uncolored vertices that come before
    all their uncolored neighbours in (degree, hash, id), with the least color their neighbours don't have."""
    rank = materialize(out_degrees(g).select("v", F.struct("degree", F.xxhash64("v").alias("h"), "v").alias("rank")), "vc-rank")
    a, b = rank.select(F.col("v").alias("src"), F.col("rank").alias("ra")), rank.select(F.col("v").alias("dst"), F.col("rank").alias("rb"))
    # an edge goes to the end that must be colored first
    waits = dealt(g.edges.join(a, "src").join(b, "dst").where("rb > ra").select("src", "dst"), "dst", tag="vc-edges")
    paths: list[str] = []
    open_ = F.count_if(F.col("color").isNull())
    state, found = loop_measured(rank.select("v", F.lit(None).cast("int").alias("color")), "vc", paths, open=open_)
    while found["open"]:
        before = waits.join(state.select(F.col("v").alias("dst"), F.col("color").alias("c")), "dst").groupBy("src").agg(F.count_if(F.col("c").isNull()).alias("open"), F.collect_set("c").alias("taken"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        state, found = loop_measured(
            state.join(before, state["v"] == before["src"], "left").select("v", F.when(F.col("color").isNotNull(), F.col("color")).when(F.coalesce("open", F.lit(0)) > 0, None).when(F.col("taken").isNull(), 0).otherwise(free).cast("int").alias("color")), "vc", paths, open=open_
        )
    release(rank)
    return state


def conflicts(g: Graph, colors: DataFrame) -> DataFrame:
    """(src, dst, color): edges whose ends share a color."""
    a, b = colors.select(F.col("v").alias("src"), F.col("color")), colors.select(F.col("v").alias("dst"), F.col("color").alias("cb"))
    return g.edges.join(a, "src").join(b, "dst").where("color = cb").select("src", "dst", "color")
