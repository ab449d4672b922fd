"""Rectangles and motifs of four vertices by what is two steps from a vertex: no wedge ever leaves a task.

Vertices lie in ranges of their ids, a task has a leaf of some ranges. Lists of neighbours are put together where their vertex
lies, and each goes once, packed, to every leaf that one of its neighbours lies in. A leaf then holds all lists of the neighbours
of its vertices, so that wedges are made, counted and closed in its memory, a bounded number at a time. What a leaf would hold is
known before anything is sent, and a leaf that would hold too much is halved, down to one range.

A rectangle is counted at its last vertex. Vertices are in the order of their ids, those of very many neighbours last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.operators.blocks import CHUNK, HUB, PACK_EDGES, expand, larger, pack, unpack
from graphspark.session import materialize

#: Edges, counted at both ends, in a range; ranges at least and at most; times that ranges are doubled to make a leaf at most.
RANGE_EDGES, RANGES, MOST_RANGES, LEVELS = 125_000, 128, 1 << 16, 4
#: Edges that a leaf of several ranges holds at most; bits that mark neighbours.
LEAF_EDGES, MARKS = 8_000_000, 1 << 25


def _both_ways(bounds: np.ndarray):
    """Edges by the leaf of most ranges that each of their ends lies in, packed."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        half = np.concatenate(held, axis=1)
        src, dst = np.concatenate([half, half[::-1]], axis=1)
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        home = np.searchsorted(bounds, src, "right") >> LEVELS
        starts = np.flatnonzero(np.diff(home, prepend=-1))
        blobs = [pack(src[lo:hi], dst[lo:hi]) for lo, hi in zip(starts, [*starts[1:], len(home)], strict=True)]
        return pa.record_batch([pa.array(home[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["t", "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
                n += batch.num_rows
            if n >= PACK_EDGES:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _meets(u: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where the list of a vertex, sorted, enters another part."""
    return np.flatnonzero((np.diff(u, prepend=u[0] - 1) != 0) | (np.diff(part, prepend=part[0]) != 0))


def _lists(bounds: np.ndarray, often: int):
    """The whole lists of a home, packed; by level and leaf what it would be sent of them; and the vertices of very many neighbours."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(blob.as_py(), 2) for rows in batches for blob in rows.column(1)]
        if not parts:
            return
        u, w = np.concatenate(parts, axis=1)
        parts.clear()
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        ids, at, degree = np.unique(u, return_inverse=True, return_counts=True)
        fine, loads = np.searchsorted(bounds, w, "right"), []
        for level in range(LEVELS + 1):
            first = _meets(u, fine >> level)
            load = np.bincount(fine[first] >> level, weights=degree[at[first]])
            loads += [{"level": level, "leaf": int(i), "load": int(load[i])} for i in np.flatnonzero(load)]
        hubs = [{"v": int(v), "d": int(d)} for v, d in zip(ids, degree, strict=True) if d > often]
        yield pa.record_batch(
            [pa.array([pack(u, w)], pa.binary()), pa.array([loads], pa.list_(pa.struct([("level", pa.int32()), ("leaf", pa.int32()), ("load", pa.int64())]))), pa.array([hubs], pa.list_(pa.struct([("v", pa.int64()), ("d", pa.int64())])))],
            ["packed", "loads", "hubs"],
        )

    return run


def _sent(bounds: np.ndarray, leaf_of: np.ndarray):
    """Each list once to every leaf that one of its neighbours lies in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for blob in rows.column(0):
                u, w = unpack(blob.as_py(), 2)
                leaf = leaf_of[np.searchsorted(bounds, w, "right")]
                starts = np.flatnonzero(np.diff(u, prepend=u[0] - 1))
                size = np.diff(starts, append=len(u))
                first = _meets(u, leaf)
                of = np.searchsorted(starts, first, "right") - 1
                order = np.argsort(leaf[first], kind="stable")
                of, to = of[order], leaf[first][order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(to)], strict=True):
                    for _, place in expand(starts[of[lo:hi]], size[of[lo:hi]], 4 * PACK_EDGES):
                        yield pa.record_batch([pa.array([int(to[lo])], pa.int32()), pa.array([pack(u[place], w[place])], pa.binary())], ["t", "packed"])

    return run


def _numbered(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, places of u, places of w)."""
    low, high = int(min(u.min(), w.min())), int(max(u.max(), w.max()))
    if high - low > 8 * len(u):
        ids = np.union1d(u, w)
        return ids, np.searchsorted(ids, u), np.searchsorted(ids, w)
    there = np.zeros(high - low + 1, bool)
    there[u - low] = there[w - low] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, place[u - low], place[w - low]


def _pairs(codes: np.ndarray, size: int) -> int:
    """How many pairs of equal codes there are."""
    if size <= 4 * len(codes):
        n = np.bincount(codes)
    else:
        codes = np.sort(codes)
        n = np.diff(np.flatnonzero(np.diff(codes, prepend=-1)), append=len(codes))
    return int((n * (n - 1) // 2).sum())


NAMES = ("all4", "k4", "tt", "ts", "ss", "s2")


def _solve(bounds: np.ndarray, leaf_of: np.ndarray, hubs: dict[int, int], whole: bool):
    def solve(u: np.ndarray, w: np.ndarray, leaf: int) -> list[int]:
        ids, u, w = _numbered(u, w)
        n = len(ids)
        own = leaf_of[np.searchsorted(bounds, ids, "right")] == leaf
        if hubs:
            last = np.array([hubs.get(int(v), 0) for v in ids])
            order = np.lexsort((ids, last))
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            u, w, own = place[u], place[w], own[order]
        codes = np.sort(u * n + w)
        u = codes // n
        w = codes - u * n
        del codes
        degree = np.bincount(u, minlength=n)
        ptr = np.cumsum(degree) - degree
        here = np.flatnonzero(own[w])
        here = here[np.argsort(w[here], kind="stable")]
        rv, ru = w[here], u[here]  # vertices of the leaf and all their neighbours
        full = np.bincount(rv, minlength=n)
        down = ru < rv
        ev, eu = rv[down], ru[down]
        cost = degree[eu]
        rows = np.flatnonzero(np.bincount(ev, minlength=n))
        ends = np.searchsorted(ev, rows, "right")
        total = np.cumsum(cost)[ends - 1] if len(rows) else np.zeros(0, np.int64)
        most = max(1, MARKS // n)
        mark = np.zeros(min(most, len(rows)) * n, bool)
        out, held, kept = dict.fromkeys(NAMES, 0), [], 0

        def flush() -> None:
            if held:
                out["k4"] += sum(len(found[0]) for found in larger(np.concatenate(held, axis=1), 4))
                held.clear()

        lo = 0
        while lo < len(rows):
            before, e0 = (total[lo - 1], ends[lo - 1]) if lo else (0, 0)
            hi = min(lo + most, max(lo + 1, int(np.searchsorted(total, before + CHUNK, "right"))))
            e1 = ends[hi - 1]
            a, b = ev[e0:e1], eu[e0:e1]
            base = (np.searchsorted(rows[lo:hi], a)) * n
            one = total[hi - 1] - before <= CHUNK
            if whole:
                r0, r1 = np.searchsorted(rv, rows[lo], "left"), np.searchsorted(rv, rows[hi - 1], "right")
                at = np.searchsorted(rows[lo:hi], rv[r0:r1])
                good = rows[lo:hi][np.minimum(at, hi - lo - 1)] == rv[r0:r1]
                marked = at[good] * n + ru[r0:r1][good]
                mark[marked] = True
                tri = np.zeros(e1 - e0, np.int64)
            many = None if one else np.zeros(n, np.int64)
            for row, at in expand(ptr[b], cost[e0:e1], CHUNK):
                x = w[at]
                code = base[row] + x
                below = code[x < a[row]]
                if many is None:
                    out["all4"] += _pairs(below, (hi - lo) * n)
                else:  # a single vertex
                    many += np.bincount(below, minlength=n)
                if whole:
                    hit = np.flatnonzero(mark[code])
                    row, x = row[hit], x[hit]
                    tri += np.bincount(row, minlength=len(tri))
                    least = x < b[row]
                    row, x = row[least], x[least]
                    if len(row):
                        held.append(np.stack([a[row], x, b[row]]))
                        kept += len(row)
            if many is not None:
                out["all4"] += int((many * (many - 1) // 2).sum())
            if whole:
                mark[marked] = False
                su, sv = degree[b] - tri - 1, full[a] - tri - 1
                for name, x in (("tt", tri * (tri - 1) // 2), ("ts", tri * (su + sv)), ("ss", su * sv), ("s2", su * (su - 1) + sv * (sv - 1))):
                    out[name] += int(x.sum())
                if kept >= CHUNK:  # whole vertices: all triangles of the batch are there
                    flush()
                    kept = 0
            lo = hi
        flush()
        return list(out.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, parts = None, []
        for rows in batches:
            for t, blob in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                leaf = t
                parts.append(unpack(blob.as_py(), 2))
        if parts:
            u, w = np.concatenate(parts, axis=1)
            parts.clear()
            yield pa.record_batch([pa.array([x], pa.int64()) for x in solve(u, w, leaf)], list(NAMES))

    return run


def _leaves(loads: dict[tuple[int, int], int], ranges: int, most: int) -> np.ndarray:
    """The leaf of each range: as many ranges as keep what it holds below ``most``."""
    out, leaf = np.empty(ranges, np.int64), 0
    todo = [(LEVELS, i) for i in range(-(-ranges >> LEVELS))][::-1]
    while todo:
        level, i = todo.pop()
        if level and loads.get((level, i), 0) > most:
            todo += [(level - 1, 2 * i + 1), (level - 1, 2 * i)]
        elif i << level < ranges:
            out[i << level : (i + 1) << level] = leaf
            leaf += 1
    return out


def four(edges: DataFrame, whole: bool = True, leaf_edges: int | None = None) -> DataFrame:
    """One row of an undirected graph (both directions, no loops, no duplicates, ids that are longs): ``all4`` rectangles,
    induced or not; if ``whole``, also ``k4`` 4-cliques and sums over edges of t triangles and su and sv other neighbours:
    ``tt`` t (t - 1) / 2, ``ts`` t (su + sv), ``ss`` su sv, ``s2`` su (su - 1) + sv (sv - 1)."""
    half = edges.where("src < dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    ends = half.select(F.explode(F.array("src", "dst")).alias("v"))
    m = half.count()
    ranges = min(MOST_RANGES, max(RANGES, 1 << (2 * m // RANGE_EDGES).bit_length()))
    cuts = ends.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []  # only balance hangs on them
    bounds = np.unique(np.array(cuts, np.int64))
    ranges = len(bounds) + 1
    homes = half.mapInArrow(_both_ways(bounds), "t int, packed binary").repartitionById((ranges - 1 >> LEVELS) + 1, F.col("t"))
    lists = materialize(homes.mapInArrow(_lists(bounds, max(HUB, m // 5000)), "packed binary, loads array<struct<level: int, leaf: int, load: long>>, hubs array<struct<v: long, d: long>>"), "lists")
    loads = {(r[0], r[1]): r[2] for r in lists.select(F.inline("loads")).groupBy("level", "leaf").agg(F.sum("load")).collect()}  # at most two for a range
    hubs = {r[0]: i + 1 for i, r in enumerate(sorted(lists.select(F.inline("hubs")).collect(), key=lambda r: (r[1], r[0])))}  # at most 10,000
    leaf_of = _leaves(loads, ranges, leaf_edges or LEAF_EDGES)
    sent = lists.select("packed").mapInArrow(_sent(bounds, leaf_of), "t int, packed binary").repartitionById(int(leaf_of.max()) + 1, F.col("t"))
    return sent.mapInArrow(_solve(bounds, leaf_of, hubs, whole), ", ".join(f"{x} long" for x in NAMES)).agg(*[F.coalesce(F.sum(x), F.lit(0).cast("long")).alias(x) for x in NAMES])
