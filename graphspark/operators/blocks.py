"""Triangles and cliques by blocks of edges: no wedge ever leaves a task.

Vertices have one of ``p`` colors by a hash. A task holds the edges between the three colors of its triple (colors may be
equal), so an edge goes to ``p`` tasks and each triangle is found in one. Edges travel packed, some three bytes each; the wedges, of
which a graph has many times more, are made and closed in memory, a bounded number at a time.

For larger cliques the triangles travel once more, packed, to the task of their first vertex; a clique is a smaller one in the
graph that the triangles of its first vertex make. Vertices are in the order of their ids, those of very many neighbours last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges in a task, edges packed at a time, wedges closed at a time.
TASK_EDGES, PACK_EDGES, CHUNK = 8_000_000, 1 << 20, 1 << 20
#: Least number of colors, and edges whose triangles' first vertices make a task of cliques, in so many parts one after the other.
COLORS, CLIQUE_EDGES, PARTS = 4, 500_000, 8
#: Vertices with more neighbours than this, and than a 5,000th of all edges, come last; so there are no more than 10,000.
HUB = 10_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashed(v: np.ndarray, shift: int) -> np.ndarray:
    return ((v.astype(np.uint64) * _ODD) >> np.uint64(shift)).astype(np.int64)


def colors_of(v: np.ndarray, p: int) -> np.ndarray:
    x = v.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return ((x >> np.uint64(33)) % np.uint64(p)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of longs, the first one ascending, as bytes by place and compressed."""
    first = np.diff(columns[0], prepend=0)
    whole = np.concatenate([first, *columns[1:]]).astype("<i8")
    return zlib.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` columns of ``pack``, as rows of an array."""
    whole = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8").reshape(n, -1).copy()
    np.cumsum(whole[0], out=whole[0])
    return whole


def triples(p: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for i in range(p) for j in range(i, p) for k in range(j, p)]


def _pack_edges(p: int):
    place = {t: n for n, t in enumerate(triples(p))}
    targets = {(i, j): [place[tuple(sorted((i, j, k)))] for k in range(p)] for i in range(p) for j in range(i, p)}

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        src, dst = np.concatenate(held, axis=1)
        a, b = colors_of(src, p), colors_of(dst, p)
        pair = np.minimum(a, b) * p + np.maximum(a, b)
        order = np.lexsort((dst, src, pair))
        src, dst, pair = src[order], dst[order], pair[order]
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        to, blobs = [], []
        for lo, hi in zip(starts, [*starts[1:], len(pair)], strict=True):
            blob = pack(src[lo:hi], dst[lo:hi])
            for t in targets[divmod(int(pair[lo]), p)]:
                to.append(t)
                blobs.append(blob)
        return pa.record_batch([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], ["t", "packed"])

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


def expand(first: np.ndarray, count: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, places): each row i with the places first[i] .. first[i] + count[i] - 1, about ``chunk`` pairs at a time."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + chunk, "right")))
        c = count[lo:hi]
        if c.any():
            start = total[lo:hi] - c - before
            yield np.repeat(np.arange(lo, hi), c), np.arange(total[hi - 1] - before) + np.repeat(first[lo:hi] - start, c)
        lo = hi


class Codes:
    """Sorted longs with a fast test of which others are among them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = max(10, int(len(codes) * 8).bit_length())
        self.shift = 64 - bits
        self.table = np.zeros(1 << bits, bool)
        self.table[_hashed(codes, self.shift)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` are there, and where."""
        maybe = np.flatnonzero(self.table[_hashed(codes, self.shift)])
        at = np.searchsorted(self.codes, codes[maybe])
        at[at == len(self.codes)] = 0
        good = self.codes[at] == codes[maybe] if len(self.codes) else np.zeros(0, bool)
        return maybe[good], at[good]


def _closed(src: np.ndarray, dst: np.ndarray, colors: np.ndarray | None, triple: tuple[int, int, int], p: int):
    """(ids, ends of the edges, chunks): the triangles as places of their edges ab, ac, bc and as places of their vertices in ids."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, m = len(ids), len(src)
    order = np.argsort(np.bincount(at, minlength=n), kind="stable")  # by the number of neighbours in this task
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ids, at = ids[order], rank[at]
    codes = np.sort(np.minimum(at[:m], at[m:]) * n + np.maximum(at[:m], at[m:]))
    a = codes // n
    b = codes - a * n
    there = Codes(codes)
    ends = np.cumsum(np.bincount(a, minlength=n))
    here = np.arange(m)
    value = dict(zip(triple[::-1], (16, 4, 1), strict=True))  # of equal colors the same value; three of a kind add up to what they should
    own = colors_of(ids, p)
    weight = np.zeros(n, np.int64)
    for color, x in value.items():
        weight[own == color] = x
    wanted = sum(value[c] for c in triple)

    def chunks():
        for ab, ac in expand(here + 1, ends[a] - 1 - here, CHUNK):
            x, y = b[ab], b[ac]
            found, bc = there.find(x * n + y)
            ab, ac, x, y = ab[found], ac[found], x[found], y[found]
            if len(set(triple)) < 3:
                right = weight[a[ab]] + weight[x] + weight[y] == wanted
                ab, ac, bc, x, y = ab[right], ac[right], bc[right], x[right], y[right]
            yield ab, ac, bc, a[ab], x, y

    return ids, (a, b), chunks()


def _solve(p: int, what: str, hubs: dict[int, int] | None = None, tasks: int = 0):
    all_triples = triples(p)

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in columns], SCHEMAS[what][1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triple, parts = None, []
        for rows in batches:
            for t, blob in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                triple = all_triples[t]
                parts.append(unpack(blob.as_py(), 2))
        if not parts:
            return
        src, dst = np.concatenate(parts, axis=1)
        parts.clear()
        ids, (a, b), chunks = _closed(src, dst, None, triple, p)
        if what == "count":
            yield batch(np.array([sum(len(c[0]) for c in chunks)], np.int64))
        elif what in ("vertices", "edges"):
            count = np.zeros(len(ids) if what == "vertices" else len(a), np.int64)
            for c in chunks:
                for x in c[3:] if what == "vertices" else c[:3]:
                    count += np.bincount(x, minlength=len(count))
            some = np.flatnonzero(count)
            if what == "vertices":
                yield batch(ids[some], count[some])
            else:
                u, v = ids[a[some]], ids[b[some]]
                yield batch(np.minimum(u, v), np.maximum(u, v), count[some])
        else:
            last = np.array([(hubs or {}).get(int(v), 0) for v in ids]) if hubs else np.zeros(len(ids), np.int64)
            by_place = np.lexsort((ids, last))
            place = np.empty(len(ids), np.int64)
            place[by_place] = np.arange(len(ids))
            sorted_ids = ids[by_place]
            held, n = [], 0
            for c in chunks:
                rows = sorted_ids[np.sort(place[np.stack(c[3:])], axis=0)]
                if what == "rows":
                    yield batch(*rows)
                    continue
                held.append(rows)
                n += rows.shape[1]
                if n >= CHUNK:
                    yield out(held)
                    held, n = [], 0
            if n:
                yield out(held)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        """Triangles packed by the task and part of their first vertex."""
        rows = np.concatenate(held, axis=1)
        to = colors_of(rows[0], tasks * PARTS)
        order = np.lexsort((rows[0], to))
        rows, to = rows[:, order], to[order]
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        blobs = [pack(*rows[:, lo:hi]) for lo, hi in zip(starts, [*starts[1:], len(to)], strict=True)]
        return pa.record_batch([pa.array((to[starts] // PARTS).astype(np.int32)), pa.array((to[starts] % PARTS).astype(np.int32)), pa.array(blobs, pa.binary())], ["t", "part", "packed"])

    return run


SCHEMAS = {
    "count": ("n long", ["n"]),
    "vertices": ("v long, n long", ["v", "n"]),
    "edges": ("src long, dst long, n long", ["src", "dst", "n"]),
    "rows": ("a long, b long, c long", ["a", "b", "c"]),
    "packed": ("t int, part int, packed binary", ["t", "part", "packed"]),
}


def _half(edges: DataFrame) -> tuple[DataFrame, int]:
    half = edges.where("src < dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return half, half.count()


def closed(edges: DataFrame, what: str, task_edges: int | None = None) -> DataFrame:
    """Triangles of an undirected graph (both directions, no loops, no duplicates, ids that are longs): ``rows`` (a, b, c);
    or, by task, ``count`` (n), ``vertices`` (v, n) and ``edges`` (src, dst, n), to be added up."""
    half, m = _half(edges)
    return _triangles(half, m, what, task_edges)


def _triangles(half: DataFrame, m: int, what: str, task_edges: int | None = None, hubs: dict[int, int] | None = None, tasks: int = 0) -> DataFrame:
    p = max(COLORS, int(np.ceil(np.sqrt(6 * m / (task_edges or TASK_EDGES)))))
    packed = half.mapInArrow(_pack_edges(p), "t int, packed binary")
    return packed.repartitionById(len(triples(p)), F.col("t")).mapInArrow(_solve(p, what, hubs, tasks), SCHEMAS[what][0])


def larger(rows: np.ndarray, k: int) -> Iterator[list[np.ndarray]]:
    """Of all triangles of some first vertices, the k-cliques as columns of vertices."""
    ids, at = np.unique(rows, return_inverse=True)
    n = len(ids)
    a, b, c = at.reshape(rows.shape)
    pairs, pid = np.unique(a * n + b, return_inverse=True)
    codes = pid * n + c
    order = np.argsort(codes)
    a, b, c, pid, codes = a[order], b[order], c[order], pid[order], codes[order]
    there = Codes(codes)
    first = np.searchsorted(pid, np.arange(len(pairs) + 1))

    def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of a pair, or the number of pairs if no triangle begins with it."""
        want = x * n + y
        found = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
        return np.where(pairs[found] == want, found, len(pairs))

    starts, sizes = np.append(first[:-1], 0), np.append(np.diff(first), 0)

    def extend(vertices: list[np.ndarray], pids: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        """``pids`` are those of the first vertex with every other one but the last."""
        if len(vertices) == k:
            yield [ids[v] for v in vertices]
            return
        last = pair(vertices[0], vertices[-1])
        for row, to in expand(starts[last], sizes[last], CHUNK):
            new = c[to]
            for q in pids:
                kept, _ = there.find(q[row] * n + new)
                row, new = row[kept], new[kept]
            if len(row):
                yield from extend([*[v[row] for v in vertices], new], [*[q[row] for q in pids], last[row]])

    yield from extend([a, b, c], [pid])


def _grow(k: int, listed: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[bytes]] = [[] for _ in range(PARTS)]
        for batch in batches:
            for part, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts[part].append(blob.as_py())
        for blobs in parts:
            if blobs:
                rows = np.concatenate([unpack(x, 3) for x in blobs], axis=1)
                blobs.clear()
                for found in larger(rows, k):
                    yield pa.record_batch([pa.array(x) for x in (found if listed else [[len(found[0])]])], [f"v{i}" for i in range(k)] if listed else ["n"])

    return run


def cliques(edges: DataFrame, k: int, listed: bool = True, task_edges: int | None = None) -> DataFrame:
    """(v0 .. vk-1) of each clique of k >= 4 vertices, or, if not ``listed``, numbers (n) to be added up."""
    half, m = _half(edges)
    often = edges.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") > max(HUB, m // 5000)).collect()  # at most 10,000
    hubs = {r[0]: i + 1 for i, r in enumerate(sorted(often, key=lambda r: (r[1], r[0])))}
    tasks = max(8, -(-m // CLIQUE_EDGES))
    found = _triangles(half, m, "packed", task_edges, hubs, tasks)
    return found.repartitionById(tasks, F.col("t")).mapInArrow(_grow(k, listed), ", ".join(f"v{i} long" for i in range(k)) if listed else "n long")
