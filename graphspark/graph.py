"""The graph model: edges(src, dst[, weight]) and vertices(v[, label]) as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.session import materialize, spread


@dataclass(frozen=True)
class Graph:
    """An immutable graph. ``vertices`` holds every vertex, isolated ones included."""

    edges: DataFrame
    vertices: DataFrame
    directed: bool = True

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, rows: int | None = None) -> Graph:
        """A normalized graph: long ids, no loops, no duplicates (of weighted ones the least weight stays, those of
        different ``elabel`` are apart); an undirected graph holds both directions of every edge. ``rows`` is as in ``dedup``."""
        if not {"src", "dst"} <= set(edges.columns):
            raise ValueError("edges need columns src and dst")
        keep = ["src", "dst"] + [c for c in ("weight", "elabel") if c in edges.columns]
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *keep[2:])
        v = e.select(F.col("src").alias("v")).union(e.select(F.col("dst").alias("v"))).distinct() if vertices is None else vertices.withColumn("v", F.col("v").cast("long"))
        e = e.where("src <> dst")
        if not directed:
            e = symmetrize(e)
            rows = None if rows is None else 2 * rows
        return cls(dedup(e, rows), v, directed)

    def undirected(self) -> Graph:
        return self if not self.directed else Graph(dedup(symmetrize(self.edges)), self.vertices, False)

    def transposed(self) -> Graph:
        return Graph(transpose(self.edges), self.vertices, self.directed)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.unionByName(transpose(edges))


def dedup(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Duplicate edges become one; of weighted duplicates the least weight stays. Edges with labels (``elabel``) are duplicates
    only if their labels agree. With their number of ``rows``, they are dealt over as many tasks as that asks for."""
    keys = ["src", "dst"] + (["elabel"] if "elabel" in edges.columns else [])
    if rows is not None:
        edges = spread(edges, rows, *keys)
    return edges.groupBy(*keys).agg(F.min("weight").alias("weight")) if "weight" in edges.columns else edges.select(*keys).distinct()


def out_degrees(g: Graph) -> DataFrame:
    """(v, degree), 0 for vertices without out-edges."""
    return _degrees(g, "src")


def in_degrees(g: Graph) -> DataFrame:
    return _degrees(g, "dst")


def _degrees(g: Graph, end: str) -> DataFrame:
    counted = g.edges.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("degree"))
    return g.vertices.select("v").join(counted, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def check_degrees(g: Graph) -> None:
    """Raises ValueError for a graph without edges."""
    if g.edges.isEmpty():
        raise ValueError("the graph has no edges")


def orient(edges: DataFrame) -> DataFrame:
    """The acyclic half of an undirected graph: towards the end of larger (degree, id)."""
    deg = edges.groupBy("src").agg(F.count("*").alias("d"))
    both = edges.join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return both.where((F.col("dd") > F.col("ds")) | ((F.col("dd") == F.col("ds")) & (F.col("dst") > F.col("src")))).select("src", "dst")


def half_edges(edges: DataFrame, ascending: bool = True) -> DataFrame:
    """One row per undirected edge: src < dst, or src > dst."""
    return edges.where("src < dst" if ascending else "src > dst")


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Adds the place of each row in ``order``, from 0. Rows are dealt by range of all of ``order``, each range counts its own, and
    the few ranges' sizes give each its start: no task sees all rows, nor all rows of one value."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # a row a range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn(name, within).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col(name)).drop("__part", "__start")


def relabel_by_degree(g: Graph) -> tuple[Graph, DataFrame]:
    """New ids 0.. by falling (degree, id); also (v, new_id)."""
    if g.directed:
        raise ValueError("relabelling takes an undirected graph")
    ids = materialize(numbered(out_degrees(g), F.desc("degree"), F.desc("v"), name="new_id").select("v", "new_id"), "relabelled")
    a, b = ids.select(F.col("v").alias("src"), F.col("new_id").alias("s")), ids.select(F.col("v").alias("dst"), F.col("new_id").alias("d"))
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    edges = g.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)
    return Graph(edges, ids.select(F.col("new_id").alias("v")), False), ids


def label_frequency(g: Graph) -> DataFrame:
    """(label, frequency)."""
    return g.vertices.groupBy("label").agg(F.count("*").alias("frequency"))


def label_index(g: Graph) -> DataFrame:
    """(label, v, position): the vertices of each label, numbered in order from 1; rows rather than one array per label."""
    places = numbered(g.vertices.select("label", "v"), F.col("label"), F.col("v"))
    sizes = label_frequency(g)  # a row a label
    before = sizes.select("label", (F.sum("frequency").over(Window.orderBy("label")) - F.col("frequency")).alias("before"))
    return places.join(before, "label").select("label", "v", (F.col("number") - F.col("before") + 1).alias("position"))


def frequent_labels(g: Graph, threshold: int) -> DataFrame:
    return label_frequency(g).where(F.col("frequency") > threshold)


def frequent_vertices(g: Graph, threshold: int) -> DataFrame:
    return g.vertices.join(label_frequency(g).where(F.col("frequency") >= threshold), "label", "left_semi")


def neighbor_label_frequency(g: Graph) -> DataFrame:
    """(v, frequencies): a map of label to number of neighbours with it."""
    labels = g.vertices.select(F.col("v").alias("dst"), "label")
    counted = g.edges.join(labels, "dst").groupBy(F.col("src").alias("v"), "label").agg(F.count("*").cast("int").alias("n"))
    return counted.groupBy("v").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("frequencies"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbors): sorted arrays without duplicates."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
