"""Graphs derived from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.session import materialize, measured, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seq_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: consecutive parts of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.where("dst is not null and src <> dst").distinct()


def seq_graph(spark: SparkSession, sf_dir: str) -> Graph:
    edges = materialize(seq_edges(spark, sf_dir), "seq")
    return Graph(edges, edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct(), True)


def weighted_seq_graph(spark: SparkSession, sf_dir: str) -> Graph:
    g = seq_graph(spark, sf_dir)
    return Graph(g.edges.withColumn("weight", F.lit(1) + (F.lit(31) * F.col("src") + F.lit(17) * F.col("dst")) % 255), g.vertices, True)


def directed_pairs_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed, with many strong components: each pair of parts in two common orders, towards the greater part if
    (31 u + 17 v) is even and towards the lesser if not."""
    up = F.pmod(F.lit(31) * F.col("u") + F.lit(17) * F.col("v"), F.lit(2)) == 0
    pairs = common_order_edges(spark, sf_dir, 2).select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("dst"))
    edges = materialize(pairs, "directed-pairs")
    return Graph(edges, edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct(), True)


def common_order_edges(spark: SparkSession, sf_dir: str, orders: int = 1) -> DataFrame:
    """(u, v), u < v: parts that share at least so many orders.

    An order is a row with the set of its parts, and its pairs are made there. They are counted over as many tasks as their
    number asks for: pairs hardly repeat, so a count ahead of the shuffle would hold them all and save nothing.
    """
    sets = table(spark, sf_dir, "lineitem").where("l_partkey is not null and l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p")).where(F.size("p") > 1)
    size = F.size("p").cast("long")
    sets, found = measured(sets.select("p"), "orders", pairs=F.sum(size * (size - 1) / 2))
    lesser = sets.select("p", F.explode("p").alias("u"))
    pairs = lesser.select("u", F.explode(F.filter("p", lambda x: x > F.col("u"))).alias("v"))
    dealt = spread(pairs, int(found["pairs"] or 0), "u", "v")
    return dealt.distinct() if orders == 1 else dealt.groupBy("u", "v").agg(F.count("*").alias("n")).where(F.col("n") >= orders).select("u", "v")


def _both(pairs: DataFrame) -> Graph:
    """An undirected graph of written pairs; its edges are these pairs read both ways."""
    edges = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(pairs.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    return Graph(edges, edges.select(F.col("src").alias("v")).distinct(), False)


def cop2_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and sparse: parts in two common orders."""
    return _both(materialize(common_order_edges(spark, sf_dir, 2), "cop2"))


def cop_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected, whole: parts in any common order."""
    return _both(materialize(common_order_edges(spark, sf_dir, 1), "cop"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, i, r): customers, suppliers and the mean quantity."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("i")).agg(F.avg("l_quantity").alias("r"))


def part_labels(spark: SparkSession, sf_dir: str, classes: int = 4) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), (F.col("p_size") % classes).cast("int").alias("label"))
