"""Writers of graph files (text, one part per partition) and small report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph, dedup, half_edges, in_degrees, out_degrees, symmetrize


def write_lines(lines: DataFrame, path: str, head: str | None = None) -> None:
    """Lines as text, a part a partition; a header is a part of its own that sorts first, the others stay where they are."""
    if head is not None:
        spark = lines.sparkSession
        lines = spark.range(1, numPartitions=1).select(F.lit(head).alias("value")).unionByName(lines.select(F.col(lines.columns[0]).alias("value")))
    lines.write.mode("errorifexists").text(path)


def _line(*cols) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def write_mtx(g: Graph, path: str) -> None:
    n, m = g.vertices.count(), g.edges.count()
    kind = "real" if g.weighted else "pattern"
    cols = [F.col("src") + 1, F.col("dst") + 1] + (["weight"] if g.weighted else [])
    write_lines(g.edges.select(_line(*cols).alias("value")), path, f"%%MatrixMarket matrix coordinate {kind} general\n{n} {n} {m}")


def write_el(g: Graph, path: str, base: int = 0, header: bool = False) -> None:
    cols = [F.col("src") + base, F.col("dst") + base] + (["weight"] if g.weighted else [])
    write_lines(g.edges.select(_line(*cols).alias("value")), path, f"{g.vertices.count()} {g.edges.count()}" if header else None)


def write_gr(g: Graph, path: str) -> None:
    """DIMACS shortest-path lines; weights are whole numbers, 1 where there are none."""
    weight = F.col("weight").cast("long") if g.weighted else F.lit(1)
    write_lines(g.edges.select(_line(F.lit("a"), F.col("src") + 1, F.col("dst") + 1, weight).alias("value")), path, f"p sp {g.vertices.agg(F.max('v')).first()[0] + 1} {g.edges.count()}")


def write_metis(g: Graph, path: str) -> None:
    """METIS lines: the neighbours of vertex 0, 1, .. up to the greatest id, empty for those that aren't there."""
    spark, n = g.edges.sparkSession, g.vertices.agg(F.max("v")).first()[0] + 1
    near = g.edges.groupBy(F.col("src").alias("v")).agg(F.array_join(F.array_sort(F.collect_list(F.col("dst") + 1)).cast("array<string>"), " ").alias("line"))
    rows = spark.range(n).select(F.col("id").alias("v")).join(near, "v", "left")
    ordered = rows.repartitionByRange("v").sortWithinPartitions("v").select(F.coalesce("line", F.lit("")).alias("value"))
    write_lines(ordered, path, f"{n} {g.edges.count() // 2}")


def canonical_edges(g: Graph) -> DataFrame:
    """src < dst once each, without loops."""
    return half_edges(dedup(symmetrize(g.edges.where("src <> dst"))))


def adjacency_lines(g: Graph, label: bool = True, degree: bool = False) -> DataFrame:
    """value: vertex, its label (1 without labels) or degree, and its neighbours in order."""
    near = g.edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_set("dst")).alias("n"))
    labels = F.col("label") if "label" in g.vertices.columns else F.lit(1)
    rows = g.vertices.select("v", labels.alias("label")).join(near, "v", "left")
    middle = ([F.col("label").cast("string")] if label else []) + ([F.coalesce(F.size("n"), F.lit(0)).cast("string")] if degree else [])
    return rows.select(F.concat_ws(" ", F.col("v").cast("string"), *middle, F.col("n").cast("array<string>")).alias("value"))


def labelled_lines(g: Graph) -> DataFrame:
    """value: t, v and e lines of a labelled graph; edges once, with their label or 0."""
    labels = F.col("label") if "label" in g.vertices.columns else F.lit(1)
    e = F.col("elabel") if "elabel" in g.edges.columns else F.lit(0)
    head = g.vertices.sparkSession.createDataFrame([(0, 0, 0, "t # 0")], "kind int, a long, b long, value string")
    vs = g.vertices.select(F.lit(1).alias("kind"), F.col("v").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), F.col("v").cast("string"), labels.cast("string")).alias("value"))
    es = half_edges(g.edges).select(F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.lit("e"), F.col("src").cast("string"), F.col("dst").cast("string"), e.cast("string")).alias("value"))
    return head.unionByName(vs).unionByName(es).repartitionByRange("kind", "a", "b").sortWithinPartitions("kind", "a", "b").select("value")


def write_labelled(g: Graph, path: str) -> None:
    write_lines(labelled_lines(g), path)


def write_adjacency(g: Graph, path: str, label: bool = True, degree: bool = False) -> None:
    write_lines(adjacency_lines(g, label, degree), path)


def write_degrees(g: Graph, path: str) -> None:
    """Folders in_degree and out_degree of lines ``vertex degree``."""
    for name, table in (("in_degree", in_degrees(g)), ("out_degree", out_degrees(g))):
        write_lines(table.select(_line("v", "degree").alias("value")), f"{path}/{name}")


def component_report(components: DataFrame) -> DataFrame:
    """(size, components): how many components there are of each size."""
    return components.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def write_component_report(components: DataFrame, path: str) -> None:
    """Folders trivial (components of one vertex), labels and distribution."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    write_lines(sizes.where("size = 1").select(_line("component").alias("value")), f"{path}/trivial")
    write_lines(components.select(_line("v", "component").alias("value")), f"{path}/labels")
    write_lines(component_report(components).select(_line("size", "components").alias("value")), f"{path}/distribution")


def write_labels(g: Graph, path: str) -> None:
    """Lines ``vertex label``."""
    write_lines(g.vertices.select(_line("v", "label").alias("value")), path)


def exclusive_prefix_sum(df: DataFrame, order: str, value: str, out: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over the rows before each in ``order``.

    Rows are dealt by range, each range adds up on its own, and the few range totals give each its start; no single task
    sees all rows. ``order`` must not repeat.
    """
    from pyspark.sql import Window

    from graphspark.session import materialize

    dealt = materialize(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "prefix")
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__s"))
    starts = totals.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, "__part").withColumn(out, F.col(out) + F.col("__start")).drop("__part", "__start")
