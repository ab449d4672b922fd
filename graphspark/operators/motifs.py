"""Triangles, cliques and motif counts of undirected graphs (edges in both directions, no loops, no duplicates)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import half_edges
from graphspark.operators import blocks, twohop
from graphspark.operators.patterns import match

MOTIFS = {3: ["wedge", "triangle"], 4: ["path4", "star3", "rectangle", "tailed_triangle", "diamond", "clique4"]}


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: each triangle once."""
    return blocks.closed(edges, "rows")


def triangle_count(edges: DataFrame) -> DataFrame:
    return blocks.closed(edges, "count").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    """(v, triangles) of the vertices that are in one."""
    return blocks.closed(edges, "vertices").groupBy("v").agg(F.sum("n").alias("triangles"))


def edge_triangles(edges: DataFrame) -> DataFrame:
    """(src, dst, tri), src < dst: the triangles on each edge, 0 included."""
    on = blocks.closed(edges, "edges").groupBy("src", "dst").agg(F.sum("n").alias("tri"))
    return half_edges(edges.select("src", "dst")).join(on, ["src", "dst"], "left").select("src", "dst", F.coalesce("tri", F.lit(0)).alias("tri"))


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """(v0 .. vk-1): each k-clique once."""
    if k < 2:
        raise ValueError("k is at least 2")
    if k == 2:
        return half_edges(edges).select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    return triangles(edges).toDF("v0", "v1", "v2") if k == 3 else blocks.cliques(edges, k)


def clique_count(edges: DataFrame, k: int) -> DataFrame:
    if k == 3:
        return triangle_count(edges)
    if k > 3:
        return blocks.cliques(edges, k, listed=False).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))
    return cliques(edges, k).agg(F.count("*").alias("total"))


def motifs(edges: DataFrame, k: int, listed: bool = False) -> DataFrame:
    """(motif, total): vertex-induced connected subgraphs of k = 3, 4 or 5 vertices; names for 3 and 4, for 5 the class
    (edges; degrees; triangles), of which there are 21. Three and four vertices are counted by formula, or, if ``listed``, by
    matching every motif, which lists the stars of a hub."""
    if k == 5:
        return motif_classes(edges, 5)
    if not listed:
        return motifs_by_formula(edges, k)
    if k not in MOTIFS:
        raise ValueError("k is 3, 4 or 5")
    out = None
    for name in MOTIFS[k]:
        one = match(edges, name, induced=True).agg(F.lit(name).alias("motif"), F.count("*").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def motifs_by_formula(edges: DataFrame, k: int) -> DataFrame:
    """As ``motifs`` for k = 3 and 4: only triangles and 4-cliques are enumerated, rectangles come from
    the counts of wedges over two ends, the rest is algebra over edges."""
    edges = edges.select("src", "dst")
    if k == 3:
        deg = edges.groupBy("src").agg(F.count("*").alias("d"))
        t = triangle_count(edges).withColumnRenamed("total", "t")
        w = deg.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0)).cast("long").alias("w"))
        totals = t.crossJoin(w).select(F.expr("stack(2, 'triangle', t, 'wedge', w - 3 * t) as (motif, total)"))
        return totals
    if k != 4:
        raise ValueError("k is 3 or 4")
    sums = twohop.four(edges)  # a diamond holds one rectangle that isn't induced, a 4-clique three
    one = sums.withColumn("diamond", F.expr("tt - 6 * k4")).withColumn("c4", F.expr("all4 - diamond - 3 * k4")).withColumn("tailed", F.expr("ts div 2 - 2 * diamond"))
    return one.select(F.expr("stack(6, 'path4', ss - 4 * c4, 'star3', (s2 - 2 * tailed) div 6, 'rectangle', c4, 'tailed_triangle', tailed, 'diamond', diamond, 'clique4', k4) as (motif, total)"))


def connected_sets(edges: DataFrame, k: int) -> DataFrame:
    """(s): sorted arrays of the vertices of each connected induced subgraph of k vertices, once each."""
    e = edges.select("src", "dst")
    sets = half_edges(e).select(F.array("src", "dst").alias("s"))
    for _ in range(k - 2):
        grown = sets.select("s", F.explode("s").alias("src")).join(e, "src").where(~F.array_contains("s", F.col("dst")))
        sets = grown.select(F.array_sort(F.array_append("s", F.col("dst"))).alias("s")).distinct()
    return sets


def motif_classes(edges: DataFrame, k: int) -> DataFrame:
    """(motif, total) by class (edges; sorted degrees; triangles), which tells all connected graphs of up to 5 vertices apart."""
    pairs = list(combinations(range(k), 2))
    sets = connected_sets(edges, k)
    inner = sets.select("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("s")[i].alias("src"), F.col("s")[j].alias("dst")) for i, j in pairs])).alias("p")).select("s", "p.*")
    found = inner.join(half_edges(edges.select("src", "dst")), ["src", "dst"], "left_semi").groupBy("s").agg(F.sum(F.pow(F.lit(2.0), F.col("i") * k + F.col("j"))).cast("long").alias("bits"))
    counted = found.groupBy("bits").agg(F.count("*").alias("n"))  # at most 2 ** (k * (k - 1) / 2) rows
    has = lambda i, j: F.getbit("bits", F.lit(i * k + j)).cast("int")
    total = lambda cols: sum(cols[1:], cols[0])
    degrees = F.array_sort(F.array(*[total([has(*sorted((i, j))) for j in range(k) if j != i]) for i in range(k)]))
    tri = total([has(a, b) * has(b, c) * has(a, c) for a, b, c in combinations(range(k), 3)])
    name = F.concat(total([has(i, j) for i, j in pairs]).cast("string"), F.lit("; "), F.array_join(degrees.cast("array<string>"), " "), F.lit("; "), tri.cast("string"))
    return counted.groupBy(name.alias("motif")).agg(F.sum("n").alias("total"))
