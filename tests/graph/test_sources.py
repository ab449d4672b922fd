"""Readers, writers, converters, generators, streaming and the command line on small files of our own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark import cli
from graphspark.functions import reductions
from graphspark.graph import Graph, in_degrees
from graphspark.sources import convert, generators, readers, writers
from graphspark.streaming.incremental import IncrementalComponents, stream_components


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def edges(g):
    return sorted(tuple(r) for r in g.edges.collect())


def test_mtx(spark, tmp_path):
    plain = put(tmp_path, "a.mtx", "% note\n3 3 3\n1 2\n2 3\n3 3\n")
    g = readers.read_mtx(spark, plain)
    assert edges(g) == [(0, 1), (1, 2)] and g.vertices.count() == 3
    sym = put(tmp_path, "b.mtx", "%%MatrixMarket matrix coordinate integer symmetric\n% c\n4 4 2\n2 1 -5\n4 3 2\n")
    assert edges(readers.read_mtx(spark, sym)) == [(0, 1, 5.0), (1, 0, 5.0), (2, 3, 2.0), (3, 2, 2.0)]
    assert edges(readers.read_mtx(spark, sym, weights="none", symmetric=False)) == [(1, 0), (3, 2)]
    assert edges(readers.read_mtx(spark, sym, weights="one"))[0] == (0, 1, 1.0)
    with pytest.raises(ValueError):
        readers.read_mtx(spark, plain, strict=True)
    head_again = put(tmp_path, "c.mtx", "2 2 2\n2 2 2\n1 2 7\n")  # an entry that reads like the size line
    assert readers._without_header(readers._lines(spark, head_again, "%"), "2 2 2").count() == 2
    ratings = put(tmp_path, "r.mtx", "%%MatrixMarket matrix coordinate real general\n2 3 2\n1 3 0.25\n2 1 0.5\n")
    assert sorted(map(tuple, readers.read_ratings_mtx(spark, ratings).collect())) == [(0, 2, 0.25), (1, 0, 0.5)]


def test_other_formats(spark, tmp_path):
    gr = put(tmp_path, "a.gr", "c x\np sp 3 2\na 1 2 9\na 3 1 4\n")
    assert edges(readers.load_graph(spark, gr)) == [(0, 1, 9), (2, 0, 4)]
    metis = put(tmp_path, "a.graph", "% c\n4 2\n2\n1 3\n2\n\n")
    g = readers.load_graph(spark, metis)
    assert edges(g) == [(0, 1), (1, 0), (1, 2), (2, 1)] and g.vertices.count() == 4
    weighted = put(tmp_path, "w.graph", "3 2 1\n2 5\n1 5 3 7\n2 7\n")
    assert edges(readers.load_graph(spark, weighted)) == [(0, 1, 5), (1, 0, 5), (1, 2, 7), (2, 1, 7)]
    assert edges(readers.load_graph(spark, put(tmp_path, "a.el", "0 1\n1 2\n"))) == [(0, 1), (1, 2)]
    assert edges(readers.load_graph(spark, put(tmp_path, "a.wel", "0 1 3\n"))) == [(0, 1, 3.0)]
    assert edges(readers.read_el(spark, put(tmp_path, "h.el", "3 2\n1 2\n3 2\n"), header=True, base=1)) == [(0, 1), (2, 1)]
    lg = readers.load_graph(spark, put(tmp_path, "a.lg", "t # 0\nv 0 7\nv 1 8\nv 2 7\ne 0 1 2\ne 1 1 3\n"))
    assert edges(lg) == [(0, 1, 2), (1, 0, 2)] and {r.v: r.label for r in lg.vertices.collect()} == {0: 7, 1: 8, 2: 7}
    adj = readers.load_graph(spark, put(tmp_path, "a.adj", "0 5 1 2\n1 6 0\n2 5\n"))
    assert edges(adj) == [(0, 1), (0, 2), (1, 0), (2, 0)] and {r.v: r.label for r in adj.vertices.collect()} == {0: 5, 1: 6, 2: 5}
    assert readers.read_pattern(spark, put(tmp_path, "p.txt", "1 2\n2 3\n")) == [(0, 1), (1, 2)]
    assert readers.read_pattern(spark, put(tmp_path, "q.txt", "4 0 5 1\n5 1 9 0\n")) == [(0, 1), (1, 2)]
    marked = put(tmp_path, "m.txt", "1 2\n2 3\n1 3 -\n")
    assert readers.read_pattern_pairs(spark, marked) == ([(0, 1), (1, 2)], [(0, 2)], [None] * 3)
    assert readers.read_pattern_pairs(spark, put(tmp_path, "l.txt", "4 2 5 1\n5 1 9 0 -\n")) == ([(0, 1)], [(1, 2)], [2, 1, 0])
    for bad in (marked, put(tmp_path, "b.txt", "1\n")):
        with pytest.raises(ValueError):
            readers.read_pattern(spark, bad)
    with pytest.raises(ValueError):
        readers.load_graph(spark, "x.unknown")


def test_binary_formats(spark, tmp_path):
    put(tmp_path, "g.meta.txt", "3\n3\n4\n2\n")
    np.array([0, 2, 2, 3], dtype="<i8").tofile(tmp_path / "g.vertex.bin")
    np.array([1, 2, 0], dtype="<i4").tofile(tmp_path / "g.edge.bin")
    assert edges(readers.read_csr(spark, str(tmp_path / "g"))) == [(0, 1), (0, 2), (2, 0)]
    np.array([4, 5, 6], dtype="u1").tofile(tmp_path / "g.vlabel.bin")
    assert {r.v: r.label for r in readers.read_csr(spark, str(tmp_path / "g")).vertices.collect()} == {0: 4, 1: 5, 2: 6}
    head = bytes([1]) + np.array([3, 3], dtype="<i8").tobytes() + np.array([0, 2, 2, 3], dtype="<i8").tobytes()
    (tmp_path / "a.sg").write_bytes(head + np.array([1, 2, 0], dtype="<i4").tobytes())
    (tmp_path / "a.wsg").write_bytes(head + np.array([1, 9, 2, 8, 0, 7], dtype="<i4").tobytes())
    assert edges(readers.load_graph(spark, str(tmp_path / "a.sg"))) == [(0, 1), (0, 2), (2, 0)]
    assert edges(readers.load_graph(spark, str(tmp_path / "a.wsg"))) == [(0, 1, 9), (0, 2, 8), (2, 0, 7)]


def test_round_trips(spark, tmp_path):
    source = put(tmp_path, "s.el", "0 1\n2 1\n3 0\n")
    g = readers.load_graph(spark, source)
    writers.write_mtx(g, str(tmp_path / "o.mtx"))
    assert edges(readers.read_mtx(spark, str(tmp_path / "o.mtx"))) == edges(g)
    want = {"sel": [(0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (3, 0)], "cel": [(0, 1), (0, 3), (1, 2)], "el": edges(g)}
    for kind, rows in want.items():
        convert.convert(spark, source, str(tmp_path / kind), "el", kind)
        assert edges(readers.read_el(spark, str(tmp_path / kind))) == rows
    convert.convert(spark, source, str(tmp_path / "x.sadj"), "el", "sadj")
    assert edges(readers.read_adj(spark, str(tmp_path / "x.sadj"))) == want["sel"]
    convert.convert(spark, source, str(tmp_path / "x.lg"), "el", "ctxt")
    assert [e[:2] for e in edges(readers.read_labelled(spark, str(tmp_path / "x.lg")))] == want["sel"]
    convert.convert(spark, source, str(tmp_path / "deg"), "el", "adj")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "deg")).collect()) == ["0 1 1", "1 0", "2 1 1", "3 1 0"]
    writers.write_degrees(g, str(tmp_path / "degrees"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "degrees/in_degree")).collect()) == ["0 1", "1 2", "2 0", "3 0"]
    ratings = put(tmp_path, "r.mtx", "2 3 2\n1 3 0.25\n2 1 0.5\n")
    convert.convert(spark, ratings, str(tmp_path / "bip"), "mtx", "bip")
    assert edges(readers.read_el(spark, str(tmp_path / "bip"))) == [(0, 4, 0.25), (1, 2, 0.5)]


def test_lines_of_several_blocks_are_numbered(spark, tmp_path):
    path = put(tmp_path, "n.graph", "% note\n300 299\n" + "".join(" ".join(str(x + 1) for x in (i - 1, i + 1) if 0 <= x < 300) + ("\n% between\n" if i % 50 == 0 else "\n") for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256)
    try:
        g = readers.load_graph(spark, path)
        assert edges(g) == sorted([(i, i + 1) for i in range(299)] + [(i + 1, i) for i in range(299)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_are_parts_of_their_own(spark, tmp_path):
    df = spark.range(1000, numPartitions=6).select(F.col("id").cast("string").alias("value"))
    writers.write_lines(df, str(tmp_path / "h"), "head")
    parts = sorted(x.name for x in (tmp_path / "h").glob("part-*"))
    assert len(parts) == 7 and (tmp_path / "h" / parts[0]).read_text() == "head\n"


def test_generators(spark):
    assert sorted(r.p for r in spark.range(64).select(generators.permuted(F.col("id"), 6, 3).alias("p")).collect()) == list(range(64))
    a, b = (edges(generators.generate(spark, 6, 4, kind)) for kind in ("rmat", "rmat"))
    assert a == b and a and all(0 <= s < 64 and 0 <= d < 64 and s != d for s, d in a)
    top = lambda kind: in_degrees(generators.generate(spark, 8, 8, kind)).agg(F.max("degree")).first()[0]
    assert top("rmat") > 2 * top("uniform")
    w = generators.random_weights(generators.uniform_edges(spark, 5, 4))
    assert w.where("weight < 1 or weight > 255").count() == 0


def test_prefix_sum_and_reductions(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "i long, x long").repartition(7)
    out = {r.i: r.before for r in writers.exclusive_prefix_sum(df, "i", "x").collect()}
    assert out == {i: sum((j * 7) % 5 for j in range(i)) for i in range(50)}
    assert reductions.mode(df, "x").first().value == 0
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "row long, col long, value double")
    assert {(r.row, r.col): r.value for r in reductions.matmul(m, m).collect()} == {(0, 0): 7.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 6.0}
    grid = spark.createDataFrame([(i, j, float(i * 3 + j)) for i in range(3) for j in range(3)], "row long, col long, value double")
    assert {(r.row, r.col): r.value for r in reductions.laplace_step(grid).collect()}[(1, 1)] == 4.0


def test_stream_of_edges(spark, tmp_path):
    schema = "src long, dst long"
    batches = [[(0, 1), (2, 3)], [(1, 2), (7, 8)], [(8, 9), (0, 3)]]
    state = IncrementalComponents()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_components(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), state, str(tmp_path / "cp")).awaitTermination(120)
        if k == 0:
            assert {r.v: r.component for r in state.labels.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert {r.v: r.component for r in state.labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7, 9: 7}


def test_command_line(spark, tmp_path):
    path = put(tmp_path, "a.el", "0 1\n1 2\n2 0\n2 3\n")
    run = lambda *a: cli.run(spark, cli.parser().parse_args([*a]))
    assert run("tc", path).first()[0] == 1
    assert {r.v: r.depth for r in run("bfs", path, "-r", "1").collect()} == {0: 2, 1: 0, 2: 1, 3: 2}
    assert run("sgl", path, "--pattern", "tailed_triangle").first()[0] == 1
    assert run("kcl", path, "-k", "3").first()[0] == 1
    assert run("sgl", path, "--pattern", put(tmp_path, "p.graph", "1 2\n2 3\n1 3 -\n")).first()[0] == 2
    with pytest.raises(SystemExit):
        run("tc")


def test_vertices_without_edges(spark):
    g = Graph.of(spark.createDataFrame([], "src long, dst long"), spark.range(3).select(F.col("id").alias("v")))
    assert in_degrees(g).agg(F.sum("degree")).first()[0] == 0
