"""Readers of graph files into DataFrames; every one reads through Spark's text or binary sources.

Text formats are parsed by column expressions. A header is found without numbering
all lines: it's the least (file offset) line that isn't a comment, taken as one row.
"""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.graph import Graph, symmetrize
from graphspark.session import materialize


def _lines(spark: SparkSession, path: str, comment: str | None = None, keep_empty: bool = False) -> DataFrame:
    """(line, words) without comments."""
    df = spark.read.text(path).select(F.trim(F.col("value")).alias("line"))
    if comment:
        df = df.where(~F.col("line").startswith(comment))
    if not keep_empty:
        df = df.where("line <> ''")
    return df.withColumn("words", F.split("line", r"\s+"))


def _numbered(spark: SparkSession, path: str, comment: str | None = None, keep_empty: bool = False) -> DataFrame:
    """(n, line, words): lines in order from 0, without comments (and empty lines).

    A scan with one split a file block keeps the order of lines in a partition and that of blocks in the partitions' numbers,
    once partitions are told apart by file name and block start; each counts its lines and the few counts give each its start.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = raw.select("file", "block", "row", F.trim("value").alias("line"))
    if comment:
        rows = rows.where(~F.col("line").startswith(comment))
    if not keep_empty:
        rows = rows.where("line <> ''")
    rows = materialize(rows, "lines")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("count"))
    starts = blocks.select("file", "block", (F.sum("count").over(Window.orderBy("file", "block")) - F.col("count")).alias("start"))  # a row a block
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("row")) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), ["file", "block"]).select((F.col("start") + F.col("place")).alias("n"), "line", F.split("line", r"\s+").alias("words"))


def _first_file(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the first file by name: a folder's header is in its first part, which isn't what Spark reads first."""
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    return lines if len(files) < 2 else lines.where(F.col("_metadata.file_name") == unquote(files[0].rsplit("/", 1)[-1])).select("value")


def _first_line(spark: SparkSession, path: str, comment: str) -> list[str]:
    """The words of the first line that isn't a comment: a scan keeps the order of a file, so its first partition has it."""
    line = F.trim("value")
    return _first_file(spark, path).where(~line.startswith(comment) & (line != "")).select(F.split(line, r"\s+").alias("words")).limit(1).first()["words"]


def read_mtx(spark: SparkSession, path: str, weights: str = "auto", symmetric: bool | None = None, directed: bool = True, strict: bool = False, keep_negative: bool = False) -> Graph:
    """MatrixMarket coordinate files; ids become 0-based.

    ``weights``: ``auto`` reads a third column where there is one; ``none`` ignores it; ``one`` weighs each edge 1.
    ``symmetric=None`` follows the banner. ``strict`` requires a valid banner and a square matrix.
    Weights are doubles; negative ones become positive unless ``keep_negative``.
    """
    banner = _first_file(spark, path).limit(1).first()
    words = (banner[0] if banner else "").strip().lower().split()
    has = bool(words) and words[0] == "%%matrixmarket"
    if strict:
        if not has or len(words) != 5 or words[1] != "matrix" or words[2] != "coordinate":
            raise ValueError("not a MatrixMarket coordinate file")
        if words[3] not in ("real", "integer", "pattern", "double") or words[4] not in ("general", "symmetric"):
            raise ValueError(f"MatrixMarket {words[3]} {words[4]} isn't supported")
    size = [int(x) for x in _first_line(spark, path, "%")]
    if strict and size[0] != size[1]:
        raise ValueError("the matrix isn't square")
    rows = _lines(spark, path, "%")
    head = " ".join(map(str, size))
    # the size line has three whole numbers as well; it's left out once, by its being the first of its text
    rows = _without_header(rows, head)
    src, dst = F.col("words")[0].cast("long") - 1, F.col("words")[1].cast("long") - 1
    cols = [src.alias("src"), dst.alias("dst")]
    if weights == "one":
        cols.append(F.lit(1.0).alias("weight"))
    elif weights == "auto" and not (has and len(words) > 3 and words[3] == "pattern") and not rows.where(F.size("words") > 2).limit(1).isEmpty():
        w = F.coalesce(F.get(F.col("words"), F.lit(2)).cast("double"), F.lit(1.0))
        cols.append((w if keep_negative else F.abs(w)).alias("weight"))
    edges = rows.select(*cols)
    if symmetric or symmetric is None and has and len(words) > 4 and words[4] == "symmetric":
        edges = symmetrize(edges)
    return Graph.of(edges, spark.range(max(size[0], size[1])).select(F.col("id").alias("v")), directed)


def _without_header(rows: DataFrame, head: str) -> DataFrame:
    """Without one of the lines that spell the header's numbers: an entry that happens to read the same stays."""
    same = F.array_join("words", " ") == head
    rest = rows.where(~same)
    again = rows.where(same).groupBy("line", "words").agg(F.count("*").alias("n")).where("n > 1").select("line", "words", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("k")).drop("k")
    return rest.unionByName(again)


def read_ratings_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(u, i, r): a rectangular MatrixMarket file of real ratings, ids 0-based."""
    head = " ".join(_first_line(spark, path, "%"))
    rows = _without_header(_lines(spark, path, "%"), head)
    return rows.select((F.col("words")[0].cast("long") - 1).alias("u"), (F.col("words")[1].cast("long") - 1).alias("i"), F.col("words")[2].cast("double").alias("r"))


def read_gr(spark: SparkSession, path: str, base: int = 1, directed: bool = True) -> Graph:
    """DIMACS shortest-path files: c comments, p sp n m, a u v [w]."""
    rows = _lines(spark, path)
    n = rows.where(F.col("words")[0] == "p").select(F.col("words")[2].cast("long")).first()
    arcs = rows.where(F.col("words")[0] == "a").select((F.col("words")[1].cast("long") - base).alias("src"), (F.col("words")[2].cast("long") - base).alias("dst"), F.coalesce(F.get(F.col("words"), F.lit(3)).cast("long"), F.lit(1)).alias("weight"))
    return Graph.of(arcs, None if n is None else spark.range(n[0]).select(F.col("id").alias("v")), directed)


def read_metis(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """METIS adjacency files; fmt 0, 100 (unweighted) and 1 (weight after each neighbour); an empty line is an isolated vertex."""
    rows = _numbered(spark, path, "%", keep_empty=True)
    first = rows.where("line <> ''").orderBy("n").select("n", "words").first()
    fmt = first["words"][2] if len(first["words"]) > 2 else "0"
    if fmt not in ("0", "00", "000", "100", "1", "001"):
        raise ValueError(f"METIS format {fmt} isn't supported")
    # comment lines aren't counted, so a vertex is its line's number after the first line's
    body = rows.where(F.col("n") > first["n"]).withColumn("src", F.col("n") - (first["n"] + 1)).where("line <> ''")
    if fmt.endswith("1"):
        at = F.sequence(F.lit(0), (F.size("words") / 2).cast("int") - 1)
        pairs = body.select("src", "words", F.explode(at).alias("k")).select("src", (F.col("words")[F.col("k") * 2].cast("long") - 1).alias("dst"), F.col("words")[F.col("k") * 2 + 1].cast("long").alias("weight"))
    else:
        pairs = body.select("src", F.explode("words").alias("w")).select("src", (F.col("w").cast("long") - 1).alias("dst"))
    return Graph.of(pairs, spark.range(int(first["words"][0])).select(F.col("id").alias("v")), directed)


def read_el(spark: SparkSession, path: str, header: bool = False, base: int = 0, directed: bool = True) -> Graph:
    """Edge lists of pairs or triples; with ``header`` the first line gives the numbers of vertices and edges."""
    rows, n = _lines(spark, path, "#"), None
    if header:
        size = _first_line(spark, path, "#")
        n, rows = int(size[0]), _without_header(rows, " ".join(size))
    cols = [(F.col("words")[0].cast("long") - base).alias("src"), (F.col("words")[1].cast("long") - base).alias("dst")]
    if not rows.where(F.size("words") > 2).limit(1).isEmpty():
        cols.append(F.coalesce(F.get(F.col("words"), F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))
    return Graph.of(rows.select(*cols), None if n is None else spark.range(n).select(F.col("id").alias("v")), directed, rows.count())


def read_labelled(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """Labelled graphs: t lines, v id label, e src dst [label]; loops and duplicates go, the graph is symmetrized."""
    rows = _lines(spark, path)
    vertices = rows.where(F.col("words")[0] == "v").select(F.col("words")[1].cast("long").alias("v"), F.col("words")[2].cast("int").alias("label"))
    edges = rows.where(F.col("words")[0] == "e").select(F.col("words")[1].cast("long").alias("src"), F.col("words")[2].cast("long").alias("dst"), F.coalesce(F.get(F.col("words"), F.lit(3)).cast("int"), F.lit(0)).alias("elabel"))
    return Graph.of(edges, vertices, directed)


def read_adj(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """Labelled adjacency: src label n1 n2 .."""
    rows = _lines(spark, path)
    vertices = rows.select(F.col("words")[0].cast("long").alias("v"), F.col("words")[1].cast("int").alias("label"))
    edges = rows.select(F.col("words")[0].cast("long").alias("src"), F.explode(F.slice("words", 3, 1 << 30)).alias("w")).select("src", F.col("w").cast("long").alias("dst"))
    return Graph.of(edges, vertices, directed)


def read_pattern(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """A pattern's edges from rows ``a b``, or ``a label b label``; vertices are numbered anew from 0. A file with pairs that must
    not be edges is an error here: see ``read_pattern_pairs``."""
    edges, apart, _ = read_pattern_pairs(spark, path)
    if apart:
        raise ValueError("the pattern has pairs that must not be edges")
    return edges


def read_pattern_pairs(spark: SparkSession, path: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int | None]]:
    """(edges, pairs that must not be edges, labels) of a pattern file: rows ``a b`` or ``a label b label``, which end in ``-``
    if the pair must not be an edge. Vertices are numbered anew from 0; one without a label is free."""
    edges, apart, labels = [], [], {}
    for (w,) in _lines(spark, path, "#").select("words").toLocalIterator():
        pair = w[:-1] if w[-1] == "-" else w
        if len(pair) not in (2, 4):
            raise ValueError(f"a pattern row of {len(w)} words")
        a, b = int(pair[0]), int(pair[2] if len(pair) == 4 else pair[1])
        if len(pair) == 4:
            labels[a], labels[b] = int(pair[1]), int(pair[3])
        (edges if pair is w else apart).append((a, b))
    ids = {v: i for i, v in enumerate(sorted({x for e in edges + apart for x in e}))}
    number = lambda pairs: [(ids[a], ids[b]) for a, b in pairs]
    return number(edges), number(apart), [labels.get(v) for v in ids]


def read_csr(spark: SparkSession, prefix: str, directed: bool = True) -> Graph:
    """Binary CSR: prefix.meta.txt (vertices, edges, id size, largest degree), .vertex.bin (int64 offsets), .edge.bin (int32), and .vlabel.bin (uint8) if there is one.

    The files are read whole, one row each, and joined back by place; this is a format of single-machine tools.
    """
    meta = [int(x) for x in spark.read.text(f"{prefix}.meta.txt", wholetext=True).first()[0].split()]

    def ints(suffix: str, kind: str, out: str) -> DataFrame:
        def unpack(batches):
            for pdf in batches:
                for data in pdf.content:
                    a = np.frombuffer(data, dtype=kind)
                    for at in range(0, len(a), 1 << 16):
                        import pandas as pd

                        part = a[at : at + (1 << 16)].astype(np.int64)
                        yield pd.DataFrame({"at": np.arange(at, at + len(part)), out: part})

        return spark.read.format("binaryFile").load(f"{prefix}{suffix}").select("content").mapInPandas(unpack, f"at long, {out} long")

    offsets = ints(".vertex.bin", "<i8", "begin")
    ends = offsets.select((F.col("at") - 1).alias("at"), F.col("begin").alias("end"))
    spans = offsets.join(ends, "at").where("end > begin").select(F.col("at").alias("src"), F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("at"))
    edges = spans.join(ints(".edge.bin", "<i4", "dst"), "at").select("src", "dst")
    vertices = spark.range(meta[0]).select(F.col("id").alias("v"))
    try:
        labels = ints(".vlabel.bin", "u1", "label").select(F.col("at").alias("v"), F.col("label").cast("int").alias("label"))
        labels.schema  # noqa: B018
        vertices = vertices.join(labels, "v", "left")
    except Exception as e:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return Graph.of(edges, vertices, directed)


def read_serialized(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """Serialized CSR (.sg, .wsg): directed flag (1 byte), edges and vertices (int64), offsets (int64), neighbours (int32, or pairs of id and weight); in-edges that follow are implied by them."""

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf.content:
                directed = data[0] != 0
                m, n = np.frombuffer(data, "<i8", 2, 1).tolist()
                begin = np.frombuffer(data, "<i8", n + 1, 17)
                body = np.frombuffer(data, "<i4", m * (2 if weighted else 1), 17 + 8 * (n + 1))
                src = np.repeat(np.arange(n), np.diff(begin))
                dst, w = (body[::2], body[1::2]) if weighted else (body, np.ones(m, dtype=np.int64))
                yield pd.DataFrame({"src": [-1], "dst": [n], "weight": [int(directed)]})
                for at in range(0, m, 1 << 16):
                    yield pd.DataFrame({"src": src[at : at + (1 << 16)], "dst": dst[at : at + (1 << 16)].astype(np.int64), "weight": w[at : at + (1 << 16)].astype(np.int64)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "src long, dst long, weight long")
    head = rows.where("src = -1").first()
    edges = rows.where("src >= 0")
    return Graph.of(edges if weighted else edges.drop("weight"), spark.range(head["dst"]).select(F.col("id").alias("v")), bool(head["weight"]))


def with_labels(g: Graph, classes: int = 4, label: Column | None = None) -> Graph:
    """Labels 1..classes by a hash of the vertex, or by an expression over v, for graphs that come without."""
    return Graph(g.edges, g.vertices.select("v", (F.pmod(F.xxhash64("v"), F.lit(classes)) + 1 if label is None else label).cast("int").alias("label")), g.directed)


READERS = {"mtx": read_mtx, "gr": read_gr, "graph": read_metis, "el": read_el, "wel": read_el, "lg": read_labelled, "txt": read_labelled, "adj": read_adj, "sadj": read_adj, "sg": read_serialized, "csr": read_csr}


def load_graph(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Graph:
    """Reads by ``fmt`` or else by the path's extension."""
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt == "wsg":
        return read_serialized(spark, path, weighted=True)
    if fmt not in READERS:
        raise ValueError(f"unknown graph format {fmt}")
    return READERS[fmt](spark, path, **options)
