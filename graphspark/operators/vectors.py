"""A number for each vertex, pushed along edges in rounds: a round moves sums, not edges.

Vertices lie in ranges of their ids. A range is a row with its ids, what each sends along an edge of its own, and the numbers that
a loop keeps; its edges are rows of places of sources, in the order of their targets. A task adds up what a piece of edges sends, by
target, and the sums go to the ranges that the targets lie in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.blocks import PACK_EDGES, pack, unpack
from graphspark.session import dealt, loop_measured, materialize

#: Edges of a range, and of a row of edges; ranges at least.
RANGE_EDGES, RANGES = 1_000_000, 8
_PARTS = "t int, vertex boolean, n long, packed binary"
_STATE = ["ids", "share", "a", "b"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dealt_out(bounds: np.ndarray, vertex: bool):
    """Vertices, or edges by their sources, packed by range."""
    schema = pa.schema([("t", pa.int32()), ("vertex", pa.bool_()), ("n", pa.int64()), ("packed", pa.binary())])

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(held, axis=1)
        columns = columns[:, np.argsort(columns[0], kind="stable")]
        to = np.searchsorted(bounds, columns[0], "right")
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        return _batch([(int(to[lo]), vertex, hi - lo, pack(*columns[:, lo:hi])) for lo, hi in zip(starts, [*starts[1:], len(to)], strict=True)], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                n += batch.num_rows
            if n >= PACK_EDGES:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _laid(first: Callable[[int], tuple[np.ndarray, np.ndarray]], piece: int):
    """A range's row, and its edges."""
    schema = pa.schema([("t", pa.int32()), *[(c, pa.binary()) for c in (*_STATE, "place", "size", "dst")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, found, parts = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                t = row["t"]
                (found if row["vertex"] else parts).append(unpack(row["packed"], 1 if row["vertex"] else 2))
        if not found:
            return
        ids = np.unique(np.concatenate(found, axis=1)[0])
        src, dst = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
        order = np.argsort(dst, kind="stable")
        dst, place = dst[order], np.searchsorted(ids, src[order])
        share = 1 / np.maximum(1, np.bincount(place, minlength=len(ids)))
        yield _batch([(t, *[x.tobytes() for x in (ids, share, *first(len(ids)))], None, None, None)], schema)
        for lo in range(0, len(dst), piece):
            part = dst[lo : lo + piece]
            starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            yield _batch([(t, None, None, None, None, place[lo : lo + piece].astype(np.int32).tobytes(), np.diff(starts, append=len(part)).astype(np.int32).tobytes(), part[starts].tobytes())], schema)

    return run


def _pushed(bounds: np.ndarray, sends: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """What a piece of edges sends, added up by target, by range of targets."""
    schema = pa.schema([("t", pa.int32()), *[(c, pa.binary()) for c in (*_STATE, "dst", "sums")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
                x = sends(at("a", float), at("b", float)) * at("share", float)
                size = at("size", np.int32)
                sums = np.add.reduceat(x[at("place", np.int32)], np.cumsum(size) - size)
                some = np.flatnonzero(sums)
                dst, sums = at("dst", np.int64)[some], sums[some]
                to = np.searchsorted(bounds, dst, "right")
                starts = np.flatnonzero(np.diff(to, prepend=-1))
                if len(starts):
                    yield _batch([(int(to[lo]), None, None, None, None, dst[lo:hi].tobytes(), sums[lo:hi].tobytes()) for lo, hi in zip(starts, [*starts[1:], len(to)], strict=True)], schema)

    return run


def _settled(update: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]):
    """A range's numbers of the next round."""
    schema = pa.schema([("t", pa.int32()), *[(c, pa.binary()) for c in _STATE], ("found", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is None:
                    parts.append((np.frombuffer(row["dst"], np.int64), np.frombuffer(row["sums"])))
                else:
                    own = row
        if own is None:
            return
        ids = np.frombuffer(own["ids"], np.int64)
        into = np.zeros(len(ids))
        for dst, sums in sorted(parts, key=lambda p: (p[0][0], p[1].tobytes())):  # the same order in every run
            at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
            known = ids[at] == dst
            into[at[known]] += sums[known]  # targets of a part differ
        a, b, found = update(np.frombuffer(own["a"]), np.frombuffer(own["b"]), into)
        yield _batch([(own["t"], own["ids"], own["share"], a.tobytes(), b.tobytes(), found)], schema)

    return run


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, a in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(ids.as_py(), np.int64)), pa.array(np.frombuffer(a.as_py()))], ["v", "score"])


class Pushing:
    """Rounds over the edges of a graph whose ids are longs. A vertex keeps the numbers a and b; it sends ``sends(a, b)``, divided by
    its out-degree, along each of its edges. ``first(n)`` are the numbers of n vertices."""

    def __init__(self, g: Graph, tag: str, first: Callable, sends: Callable, range_edges: int | None = None):
        size = range_edges or RANGE_EDGES
        edges = g.edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        vertices = g.vertices.select(F.col("v").cast("long").alias("v"))
        ranges = max(RANGES, edges.count() // size)
        ends = edges.select(F.col("src").alias("v")).union(vertices)
        cuts = ends.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] or []  # only balance hangs on them
        self.bounds, self.tag, self.sends, self.paths = np.unique(np.array(cuts, np.int64)), tag, sends, []
        parts = vertices.mapInArrow(_dealt_out(self.bounds, True), _PARTS).union(edges.mapInArrow(_dealt_out(self.bounds, False), _PARTS))
        laid = parts.repartitionById(len(self.bounds) + 1, F.col("t")).mapInArrow(_laid(first, size), "t int, " + ", ".join(f"{c} binary" for c in (*_STATE, "place", "size", "dst")))
        laid = materialize(laid, tag + "-laid")
        self.laid = laid  # its files are read by the first round
        self.state = laid.where("ids is not null").select("t", *_STATE)
        self.edges = dealt(laid.where("ids is null").select("t", "place", "size", "dst"), "t", tag=tag + "-edges")

    def step(self, update: Callable, metric: Callable[[Column], Column]) -> float:
        """A round: ``update(a, b, into)`` gives a, b and a number of a range; ``metric`` of these numbers is returned."""
        columns = "t int, " + ", ".join(f"{c} binary" for c in (*_STATE, "dst", "sums"))
        sent = self.edges.join(self.state.drop("ids"), "t").select("share", "a", "b", "place", "size", "dst").mapInArrow(_pushed(self.bounds, self.sends), columns)
        whole = self.state.select("t", *_STATE, F.lit(None).cast("binary").alias("dst"), F.lit(None).cast("binary").alias("sums")).union(sent)
        new = whole.repartitionById(len(self.bounds) + 1, F.col("t")).mapInArrow(_settled(update), "t int, " + ", ".join(f"{c} binary" for c in _STATE) + ", found double")
        new, found = loop_measured(new, self.tag, self.paths, found=metric(F.col("found")))
        self.state = new.select("t", *_STATE)
        return found["found"] or 0.0

    def values(self) -> DataFrame:
        """(v, score): a of every vertex."""
        return self.state.select("ids", "a").mapInArrow(_values, "v long, score double")
