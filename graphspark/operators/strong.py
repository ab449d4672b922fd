"""Strong components by labels that travel along the edges both ways: a round moves labels, not edges.

Vertices lie in ranges of their ids, and a range has its edges both ways. In a search every vertex takes the least label that
reaches it forwards, and the least that reaches it backwards. Where the two are one label, the vertex is in a component with the one
that the label is from; otherwise vertices of one component still have the same pair of labels, so edges between different pairs
go before the next search. Labels are ids in a mixed order, so that a chain of components breaks up into shares.

In the first search only one vertex a range sends a label, that of the most in-edges times out-edges: an edge of a giant component
carries few labels. After it all do, so that each search settles the least label's component of every part of the graph at least.
A task follows labels inside its range to their end before it sends anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.blocks import CHUNK, expand, unpack
from graphspark.operators.vectors import _PARTS, _batch, _dealt_out
from graphspark.session import dealt, drop_path, loop_measured, materialize, measured, release

#: Edges of a range, each counted at its source; ranges at least.
RANGE_EDGES, RANGES = 4_000_000, 8
#: No label.
NONE = np.uint64(2**64 - 1)

# A row of a range: its vertices' state (ids, label, fresh) one way, its edges one way, or what is done (ids, label).
_STATE, _EDGES = ["ids", "label", "fresh"], ["ptr", "to", "place", "size", "dst"]
_STATE_ROW, _EDGE_ROW, _DONE_ROW = 0, 1, 2
_COUNTS = ["live", "edges"]


def _columns(names: list[str], counts: list[str] = []) -> tuple[str, pa.Schema]:
    """The schema of rows with a range, a kind, a way, binaries and counts."""
    fields = [("t", "int", pa.int32()), ("kind", "int", pa.int32()), ("way", "int", pa.int32())]
    fields += [(c, "binary", pa.binary()) for c in names] + [(c, "long", pa.int64()) for c in counts]
    return ", ".join(f"{n} {k}" for n, k, _ in fields), pa.schema([(n, a) for n, _, a in fields])


_LAID, _LAID_SCHEMA = _columns(_STATE + _EDGES, _COUNTS)
_MOVED, _MOVED_SCHEMA = _columns([*_STATE, "dst"])
_JUDGED, _JUDGED_SCHEMA = _columns(_STATE, ["live"])
_TOLD, _TOLD_SCHEMA = _columns([*_STATE, "place", "dst"])


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return _batch([tuple(x.tobytes() if isinstance(x := values.get(c), np.ndarray) else x for c in schema.names)], schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Callable]:
    """Each row as a function of a column's name and, for an array, its type."""
    for batch in batches:
        for i in range(batch.num_rows):

            def at(name: str, kind=None, batch=batch, i=i):
                x = batch.column(name)[i]
                return x.as_py() if kind is None else np.frombuffer(x.as_buffer(), kind) if x.is_valid else None

            yield at


def mixed(ids: np.ndarray) -> np.ndarray:
    """Ids in another order: different ones stay different."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``v`` among sorted ids, and which are there."""
    if not len(ids):
        return np.zeros(len(v), np.int64), np.zeros(len(v), bool)
    at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
    return at, ids[at] == v


def _mask(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).astype(bool)


def _slices(bounds: np.ndarray, dst: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of sorted ids."""
    to = np.searchsorted(bounds, dst, "right")
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    for lo, hi in zip(starts, np.append(starts, len(to))[1:], strict=True):
        yield int(to[lo]), lo, hi


def _built(t: int, ids: np.ndarray, ways: list[tuple[np.ndarray, np.ndarray]], trims: int, seeded: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a range with its vertices and (place, dst) of its edges each way; vertices without edges one way are done, and
    so, ``trims`` times, are those that lose them by that inside the range."""
    for _ in range(max(1, trims)):
        stays = np.logical_and(*[np.bincount(place, minlength=len(ids)) > 0 for place, _ in ways])
        if stays.all():
            break
        gone = ids[~stays]
        yield _row(_LAID_SCHEMA, t=t, kind=_DONE_ROW, ids=gone)
        number = np.cumsum(stays) - 1
        for way, (place, dst) in enumerate(ways):
            keep = stays[place] & ~_places(gone, dst)[1]
            ways[way] = number[place[keep]], dst[keep]
        ids = ids[stays]
    if not len(ids):
        return
    label, fresh = mixed(ids), np.ones(len(ids), bool)
    if seeded:
        degrees = [np.bincount(place, minlength=len(ids)).astype(float) for place, _ in ways]
        fresh[:] = False
        fresh[np.argmax(degrees[0] * degrees[1])] = True
        label[~fresh] = NONE
    for way, (place, dst) in enumerate(ways):
        order = np.argsort(dst, kind="stable")
        place, dst = place[order], dst[order]
        to, inside = _places(ids, dst)
        start = place[inside]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(ids)))])
        local = to[inside][np.argsort(start, kind="stable")].astype(np.int32)
        place, dst = place[~inside].astype(np.int32), dst[~inside]
        starts = np.flatnonzero(np.diff(dst, prepend=dst[:1] - 1))
        size = np.diff(starts, append=len(dst)).astype(np.int32)
        yield _row(_LAID_SCHEMA, t=t, kind=_STATE_ROW, way=way, ids=ids, label=label, fresh=np.packbits(fresh), live=len(ids))
        yield _row(_LAID_SCHEMA, t=t, kind=_EDGE_ROW, way=way, ptr=ptr, to=local, place=place, size=size, dst=dst[starts], edges=len(order) if way == 0 else 0)


def _first(trims: int):
    """Ranges of the packed parts of ``_dealt_out``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, found, parts = None, [], [[np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]]
        for batch in batches:
            for row in batch.to_pylist():
                t = row["t"]
                if row["vertex"]:
                    found.append(unpack(row["packed"], 1)[0])
                else:
                    parts[row["way"]].append(unpack(row["packed"], 2))
        if not found:
            return
        ids, ways = np.unique(np.concatenate(found)), []
        for part in parts:
            src, dst = np.concatenate(part, axis=1)
            part.clear()
            place, known = _places(ids, src)
            ways.append((place[known], dst[known]))
        yield from _built(t, ids, ways, trims, True)

    return run


def follow(label: np.ndarray, fresh: np.ndarray, ptr: np.ndarray, to: np.ndarray) -> None:
    """Least labels along edges inside a range, from the fresh ones on until nothing changes; what changes is fresh."""
    front = np.flatnonzero(fresh)
    while len(front):
        found = []
        for rows, places in expand(ptr[front], ptr[front + 1] - ptr[front], CHUNK):
            target, value = to[places], label[front[rows]]
            lower = value < label[target]
            target = target[lower]
            np.minimum.at(label, target, value[lower])
            if len(target) > len(label) // 8:
                some = np.zeros(len(label), bool)
                some[target] = True
                found.append(np.flatnonzero(some))
            else:
                found.append(np.unique(target))
        front = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        fresh[front] = True


def _pushed(bounds: np.ndarray):
    """A range's labels after those inside it have been followed, and what its edges carry to other ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _rows(batches):
            ids, label = at("ids", np.int64), at("label", np.uint64).copy()
            fresh = _mask(at("fresh", np.uint8), len(ids))
            follow(label, fresh, at("ptr", np.int64), at("to", np.int32))
            size = at("size", np.int32).astype(np.int64)
            if fresh.any() and len(size):
                least = np.minimum.reduceat(np.where(fresh, label, NONE)[at("place", np.int32)], np.cumsum(size) - size)
                some = np.flatnonzero(least != NONE)
                dst, least = at("dst", np.int64)[some], least[some]
                for t, lo, hi in _slices(bounds, dst):
                    yield _row(_MOVED_SCHEMA, t=t, way=at("way"), dst=dst[lo:hi], label=least[lo:hi])
            yield _row(_MOVED_SCHEMA, t=at("t"), way=at("way"), ids=ids, label=label)

    return run


def _taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's labels with what has come."""
    own, parts = None, []
    for at in _rows(batches):
        if at("ids") is None:
            parts.append((at("dst", np.int64).copy(), at("label", np.uint64).copy()))
        else:
            own = at
    if own is None:
        return
    ids, label = own("ids", np.int64), own("label", np.uint64).copy()
    fresh = np.zeros(len(ids), bool)
    for dst, value in parts:  # the targets of a part differ
        place, known = _places(ids, dst)
        lower = known & (value < label[place])
        label[place[lower]] = value[lower]
        fresh[place[lower]] = True
    yield _row(_JUDGED_SCHEMA, t=own("t"), kind=_STATE_ROW, way=own("way"), ids=ids, label=label, fresh=np.packbits(fresh), live=int(fresh.sum()))


def _judged(seeded: bool):
    """What a search has settled; of a range with anything left, all its vertices with their pair of labels and whether they are left."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ids, labels = None, None, {}
        for at in _rows(batches):
            t, ids = at("t"), at("ids", np.int64).copy()
            labels[at("way")] = at("label", np.uint64).copy()
        if t is None:
            return
        forth, back = labels[0], labels[1]
        done = (forth == back) & (forth != NONE) if seeded else forth == back
        if done.any():
            yield _row(_JUDGED_SCHEMA, t=t, kind=_DONE_ROW, ids=ids[done], label=forth[done])
        if not done.all():
            pair = mixed(mixed(forth.view(np.int64)).view(np.int64) ^ back.view(np.int64))
            yield _row(_JUDGED_SCHEMA, t=t, kind=_STATE_ROW, ids=ids, label=pair, fresh=np.packbits(~done), live=int((~done).sum()))

    return run


def _told(bounds: np.ndarray):
    """A range's edges from vertices that are left, and to each range that these go to the pairs of labels that they come from."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _rows(batches):
            t, way, ids, label, ptr = at("t"), at("way"), at("ids", np.int64), at("label", np.uint64), at("ptr", np.int64)
            left = _mask(at("fresh", np.uint8), len(ids))
            place, dst = at("place", np.int32), np.repeat(at("dst", np.int64), at("size", np.int32))
            place, dst = place[left[place]], dst[left[place]]
            for to, lo, hi in _slices(bounds, dst):
                known = np.zeros(len(ids), bool)
                known[place[lo:hi]] = True
                yield _row(_TOLD_SCHEMA, t=to, ids=ids[known], label=label[known])
            start, to = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ptr)), at("to", np.int32)
            same = left[start] & left[to] & (label[start] == label[to])
            yield _row(_TOLD_SCHEMA, t=t, way=way, place=np.concatenate([place, start[same]]), dst=np.concatenate([dst, ids[to[same]]]))

    return run


def _again(trims: int):
    """Ranges of the vertices that are left, with the edges between equal pairs of labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, ways = None, [], {}
        for at in _rows(batches):
            if at("fresh") is not None:
                own = at
            elif at("ids") is not None:
                known.append(np.stack([at("ids", np.int64), at("label", np.int64)]))
            else:
                ways[at("way")] = at("place", np.int32).copy(), at("dst", np.int64).copy()
        if own is None:
            return
        ids, label = own("ids", np.int64), own("label", np.int64)
        left = _mask(own("fresh", np.uint8), len(ids))
        known.append(np.stack([ids[left], label[left]]))
        others, labels = np.concatenate(known, axis=1)
        known.clear()
        order = np.argsort(others, kind="stable")
        others, labels = others[order], labels[order]
        number, kept = np.cumsum(left) - 1, []
        for way in (0, 1):
            place, dst = ways.pop(way)
            to, there = _places(others, dst)
            same = there & (labels[to] == label[place])
            kept.append((number[place[same]], dst[same]))
        yield from _built(own("t"), ids[left], kept, trims, False)

    return run


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root): what is done; a component of one has no root."""
    for at in _rows(batches):
        ids, label = at("ids", np.int64), at("label", np.int64)
        yield pa.record_batch([pa.array(ids), pa.nulls(len(ids), pa.int64()) if label is None else pa.array(label)], ["v", "root"])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of ranges' edges, forwards."""
    for at in _rows(batches):
        ids, ptr = at("ids", np.int64), at("ptr", np.int64)
        src = np.concatenate([ids[at("place", np.int32)], np.repeat(ids, np.diff(ptr))])
        dst = np.concatenate([np.repeat(at("dst", np.int64), at("size", np.int32)), ids[at("to", np.int32)]])
        yield pa.record_batch([pa.array(src), pa.array(dst)], ["src", "dst"])


def components(g: Graph, trims: int, local_edges: int, in_one_task: Callable[[DataFrame], DataFrame], range_edges: int | None = None) -> DataFrame:
    """(v, component): the least vertex id of the strong component. With ``local_edges``, what has no more edges than that is left to
    ``in_one_task``, which takes (src, dst) and returns (v, component). A task holds the edges of a range, and so all of a vertex."""
    edges = g.edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    vertices = materialize(g.vertices.select(F.col("v").cast("long").alias("v")), "strong-vertices")
    ranges = max(RANGES, edges.count() // (range_edges or RANGE_EDGES))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).union(vertices)
    cuts = ends.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] or []  # only balance hangs on them
    bounds = np.unique(np.array(cuts, np.int64))
    n = len(bounds) + 1
    parts = vertices.mapInArrow(_dealt_out(bounds, True), _PARTS).withColumn("way", F.lit(None).cast("int"))
    for way, ways in enumerate((edges, edges.select("dst", "src"))):
        parts = parts.union(ways.mapInArrow(_dealt_out(bounds, False), _PARTS).withColumn("way", F.lit(way)))
    counts = {"live": F.max("live"), "edges": F.sum("edges")}
    laid, found = measured(parts.repartitionById(n, F.col("t")).mapInArrow(_first(trims), _LAID), "strong-laid", **counts)
    release(vertices)
    finished = [materialize(laid.where(F.col("kind") == _DONE_ROW).select("ids", "label"), "strong-done")]
    rest, seeded = None, True
    while found["live"]:
        state, table = laid.where(F.col("kind") == _STATE_ROW).select("t", "way", *_STATE), laid.where(F.col("kind") == _EDGE_ROW).select("t", "way", *_EDGES)
        if found["edges"] <= local_edges:
            forth = state.where("way = 0")
            alone = in_one_task(table.join(forth.select("t", "way", "ids"), ["t", "way"]).mapInArrow(_ends, "src long, dst long"))
            left = forth.select("ids", F.lit(None).cast("binary").alias("label")).mapInArrow(_pairs, "v long, root long")
            rest = left.join(alone, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
            break
        steps = dealt(table, "t", "way", tag="strong-edges", written=True)
        paths: list[str] = []
        moving = True
        while moving:
            sent = steps.join(state.hint("shuffle_hash"), ["t", "way"]).mapInArrow(_pushed(bounds), _MOVED)
            state, some = loop_measured(sent.repartitionById(2 * n, F.col("t") * 2 + F.col("way")).mapInArrow(_taken, _JUDGED), "strong", paths, live=F.max("live"))
            moving = bool(some["live"])
        judged, some = measured(state.repartitionById(n, F.col("t")).mapInArrow(_judged(seeded), _JUDGED), "strong-judged", live=F.max("live"))
        done = judged.where(F.col("kind") == _DONE_ROW).select("ids", "label")
        left = judged.where(F.col("kind") == _STATE_ROW)
        new, found = None, {"live": 0}
        if some["live"]:
            told = steps.join(left.select("t", *_STATE).hint("shuffle_hash"), "t").mapInArrow(_told(bounds), _TOLD)
            whole = left.select("t", "kind", "way", *_STATE, F.lit(None).cast("binary").alias("place"), F.lit(None).cast("binary").alias("dst")).union(told)
            new, found = measured(whole.repartitionById(n, F.col("t")).mapInArrow(_again(trims), _LAID), "strong-laid", **counts)
            done = done.union(new.where(F.col("kind") == _DONE_ROW).select("ids", "label"))
        finished.append(materialize(done, "strong-done"))
        release(laid, steps, judged)
        for path in paths:
            drop_path(g.edges.sparkSession, path)
        laid, seeded = new, False
    done = finished[0]
    for table in finished[1:]:
        done = done.union(table)
    settled = done.mapInArrow(_pairs, "v long, root long")
    least = materialize(settled.where("root is not null").groupBy("root").agg(F.min("v").alias("component")), "strong-least")
    out = settled.where("root is null").select("v", F.col("v").alias("component")).union(settled.join(least, "root").select("v", "component"))
    return out if rest is None else out.union(rest)
