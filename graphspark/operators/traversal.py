"""Breadth-first search, shortest paths and single-source betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.connectivity import _union
from graphspark.session import dealt, loop_materialize, loop_measured, materialize, measured, release

#: Levels kept as separate tables before they are written as one.
COMPACT = 16


def bfs(g: Graph, source: int, mode: str = "push", max_depth: int | None = None) -> DataFrame:
    """(v, depth) of the vertices reachable from ``source`` along edges.

    ``mode``: ``push`` joins the frontier to its out-edges; ``pull`` joins unvisited
    vertices to their in-edges; ``auto`` pulls while the frontier's edges are over a
    fifteenth of all and pushes otherwise. The result is the same.

    Edges lie in buckets by the end that is joined, so a level moves the frontier and what it reaches, never all edges;
    a level is one job.
    """
    if mode not in ("push", "pull", "auto"):
        raise ValueError(f"unknown mode {mode}")
    pulls, pushes = mode != "push", mode != "pull"
    out_edges = dealt(g.edges.select("src", "dst"), "src", tag="edges", written=True) if pushes else None
    in_edges = dealt(g.edges.select("src", "dst"), "dst", tag="edges", written=True) if pulls else None
    total, degrees = 0, None
    if mode == "auto":
        degrees = dealt(out_edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out")), "v", tag="degrees")
        total = degrees.agg(F.sum("out")).first()[0] or 0

    def next_level(found: DataFrame, depth: int) -> tuple[DataFrame, dict]:
        """Writes a level; with ``auto``, its vertices know how many edges go out of them."""
        level = found.select("v", F.lit(depth).alias("depth"))
        if mode != "auto":
            return measured(level, "bfs")
        return measured(level.join(degrees, "v", "left").select("v", "depth", F.coalesce("out", F.lit(0)).alias("out")), "bfs", out=F.sum("out"))

    frontier, size = next_level(g.vertices.where(F.col("v") == source), 0)
    levels, tables, depth, paths = [], [], 0, []
    while size["n"] and (max_depth is None or depth <= max_depth):
        levels.append(frontier.select("v", "depth"))
        tables.append(frontier)
        if len(levels) > COMPACT:
            levels = [loop_materialize(_union(levels), "bfs-levels", paths)]
            release(*tables[:-1])  # the last one is the frontier
            tables = tables[-1:]
        depth += 1
        seen = _union(levels).select("v")
        if mode == "pull" or mode == "auto" and (size["out"] or 0) * 15 > total:
            open_ = g.vertices.select("v").join(seen, "v", "left_anti")
            own = frontier.select(F.col("v").alias("src"))
            # every open vertex looks at its in-edges; the frontier is what may be sent around
            new = in_edges.join(own, "src", "left_semi").select(F.col("dst").alias("v")).join(open_, "v", "left_semi").distinct()
        else:
            own = frontier.select(F.col("v").alias("src"))
            new = out_edges.join(own, "src", "left_semi").select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti")
        frontier, size = next_level(new, depth)
    return _union(levels) if levels else frontier.select("v", "depth")


def bfs_all(g: Graph, source: int, unreachable: int | None = None, **options) -> DataFrame:
    """As ``bfs`` with a row for every vertex; ``unreachable`` (null by default) where there is no path."""
    out = g.vertices.select("v").join(bfs(g, source, **options), "v", "left")
    return out if unreachable is None else out.select("v", F.coalesce("depth", F.lit(unreachable)).alias("depth"))


def sssp(g: Graph, source: int, delta: int | None = None, unit: bool = False) -> DataFrame:
    """(v, distance) of the vertices reachable from ``source``; weights must not be negative.

    Each round relaxes the edges of active vertices. ``delta`` takes active vertices
    in buckets of that width (nearest first); without it all of them at once.
    """
    edges = g.edges.select("src", "dst", F.lit(1).cast("long").alias("weight") if unit or not g.weighted else F.col("weight"))
    if not unit and g.weighted and not edges.where("weight < 0").isEmpty():
        raise ValueError("negative weight")
    paths: list[str] = []
    kind = edges.schema["weight"].dataType.simpleString()
    kind = "long" if kind in ("int", "bigint") else kind
    edges = dealt(edges, "src", tag="edges", written=True)
    nearest = F.min(F.when(F.col("active"), F.col("distance")))
    state, found = loop_measured(g.vertices.where(F.col("v") == source).select("v", F.lit(0).cast(kind).alias("distance"), F.lit(True).alias("active")), "sssp", paths, bound=nearest)
    limit = delta
    while found["bound"] is not None:
        if delta is not None and found["bound"] >= limit:
            limit = (found["bound"] // delta + 1) * delta
        near = F.col("active") if delta is None else F.col("active") & (F.col("distance") < limit)
        sending = state.where(near).select(F.col("v").alias("src"), "distance")
        step = edges.join(sending, "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("distance") + F.col("weight")).cast(kind).alias("distance")).select("v", "distance", F.lit(None).cast(kind).alias("old"), F.lit(False).alias("waits"))
        kept = state.select("v", "distance", F.col("distance").alias("old"), (F.col("active") & ~near).alias("waits"))
        best = kept.unionByName(step).groupBy("v").agg(F.min("distance").alias("distance"), F.min("old").alias("old"), F.max("waits").alias("waits"))
        state, found = loop_measured(best.select("v", "distance", (F.col("waits") | F.col("old").isNull() | (F.col("distance") < F.col("old"))).alias("active")), "sssp", paths, bound=nearest)
    return state.select("v", "distance")


def betweenness(g: Graph, source: int) -> DataFrame:
    """(v, depth, paths, score): Brandes' dependencies of one source, the source included, divided by their maximum.

    Vertices that can't be reached have null depth, no paths and score 0.
    """
    edges, backwards = dealt(g.edges.select("src", "dst"), "src", tag="edges", written=True), dealt(g.edges.select("src", "dst"), "dst", tag="edges", written=True)
    level, size = measured(g.vertices.where(F.col("v") == source).select("v", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")), "bc")
    levels: list[DataFrame] = []
    while size["n"]:
        levels.append(level)
        seen = _union(levels).select("v")
        step = edges.join(level.select(F.col("v").alias("src"), "paths"), "src").groupBy("dst").agg(F.sum("paths").alias("paths"))
        level, size = measured(step.join(seen, step["dst"] == seen["v"], "left_anti").select(F.col("dst").alias("v"), F.lit(len(levels)).alias("depth"), "paths"), "bc")
    none = g.edges.sparkSession.createDataFrame([], "v long, delta double")
    deltas: list[DataFrame] = []
    below, later = none, None
    for own in reversed(levels):
        if later is not None:
            onward = later.join(below, "v", "left").select(F.col("v").alias("dst"), ((1 + F.coalesce("delta", F.lit(0.0))) / F.col("paths")).alias("share"))
            below = materialize(backwards.join(onward, "dst").join(own.select(F.col("v").alias("src"), "paths"), "src").groupBy(F.col("src").alias("v")).agg(F.sum(F.col("paths") * F.col("share")).alias("delta")), "bc-back")
            deltas.append(below)
        later = own
    scores = _union(deltas) if deltas else none
    top = scores.agg(F.max("delta").alias("top"))
    reached = _union(levels) if levels else level
    return g.vertices.select("v").join(reached, "v", "left").join(scores, "v", "left").crossJoin(F.broadcast(top)).select("v", "depth", F.coalesce("paths", F.lit(0.0)).alias("paths"), F.when(F.coalesce("top", F.lit(0.0)) > 0, F.coalesce("delta", F.lit(0.0)) / F.col("top")).otherwise(0.0).alias("score"))
