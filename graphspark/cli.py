"""Command line: ``python -m graphspark.cli KERNEL GRAPH [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators import coloring, connectivity, fsm, linalg, motifs, patterns, ranking, spanning, traversal
from graphspark.sources import convert, generators, readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("kernel", choices=["bfs", "sssp", "bc", "pr", "cc", "afforest", "scc", "mst", "vc", "spmv", "tc", "kcl", "motif", "sgl", "fsm", "kcore", "convert"])
    p.add_argument("graph", nargs="?", help="a graph file; without one, -g or -u generates")
    p.add_argument("-f", "--format", help="file format, else by extension")
    p.add_argument("-g", "--rmat", type=int, metavar="SCALE", help="generate a recursive matrix graph")
    p.add_argument("-u", "--uniform", type=int, metavar="SCALE", help="generate a uniform graph")
    p.add_argument("-d", "--degree", type=int, default=16)
    p.add_argument("-s", "--symmetrize", action="store_true")
    p.add_argument("-r", "--source", type=int, default=0)
    p.add_argument("-k", type=int, default=3, help="vertices of cliques and motifs, edges of frequent patterns, or core number")
    p.add_argument("-i", "--iterations", type=int, default=100)
    p.add_argument("-t", "--tolerance", type=float, default=1e-4)
    p.add_argument("--delta", type=int)
    p.add_argument("--minsup", type=int, default=1)
    p.add_argument("--pattern", default="diamond", help="the name of a pattern, or a file of its pairs")
    p.add_argument("--induced", action="store_true")
    p.add_argument("--unit", action="store_true", help="unit weights")
    p.add_argument("--to", help="target format of convert")
    p.add_argument("-o", "--output", help="Parquet folder for the result, else it is shown")
    return p


def run(spark: SparkSession, args: argparse.Namespace):
    if args.kernel == "convert":
        return convert.convert(spark, args.graph, args.output, args.format or args.graph.rsplit(".", 1)[-1], args.to)
    if args.graph is None:
        kind, scale = ("rmat", args.rmat) if args.rmat is not None else ("uniform", args.uniform)
        if scale is None:
            raise SystemExit("a graph file, -g or -u is needed")
        g = generators.generate(spark, scale, args.degree, kind)
    else:
        g = readers.load_graph(spark, args.graph, args.format)
    if args.symmetrize or args.kernel in ("vc", "tc", "kcl", "motif", "sgl", "fsm", "kcore"):
        g = g.undirected()
    ones = Graph(g.edges if g.weighted else g.edges.withColumn("weight", F.lit(1)), g.vertices, g.directed)
    return {
        "bfs": lambda: traversal.bfs_all(g, args.source), "sssp": lambda: traversal.sssp(g, args.source, args.delta, args.unit), "bc": lambda: traversal.betweenness(g, args.source),
        "pr": lambda: ranking.pagerank(g, tolerance=args.tolerance, iterations=args.iterations)[0], "cc": lambda: connectivity.connected_components(g), "afforest": lambda: connectivity.afforest(g),
        "scc": lambda: connectivity.strongly_connected_components(g), "mst": lambda: spanning.forest_summary(ones), "vc": lambda: coloring.color(g), "kcore": lambda: connectivity.k_core(g, args.k),
        "spmv": lambda: linalg.spmv(g, g.vertices.select("v", F.lit(0.3).alias("value")), weight=0.2), "tc": lambda: motifs.triangle_count(g.edges), "kcl": lambda: motifs.clique_count(g.edges, args.k),
        "motif": lambda: motifs.motifs(g.edges, args.k), "sgl": lambda: _listing(spark, g, args),
        "fsm": lambda: fsm.frequent_subgraphs(g.edges, (g if "label" in g.vertices.columns else readers.with_labels(g)).vertices, args.k, args.minsup),
    }[args.kernel]()


def _listing(spark: SparkSession, g: Graph, args: argparse.Namespace):
    if args.pattern in patterns.PATTERNS:
        return patterns.count_pattern(g.edges, args.pattern, args.induced)
    edges, apart, labels = readers.read_pattern_pairs(spark, args.pattern)
    own = labels if any(x is not None for x in labels) else None
    return patterns.count_pattern(g.edges, edges, args.induced, vertices=g.vertices, labels=own, apart=apart)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphspark").getOrCreate()
    out = run(spark, args)
    if out is not None and args.output:
        out.write.parquet(args.output)
    elif out is not None:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
