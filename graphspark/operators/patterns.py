"""Subgraph listing: a pattern becomes a chain of joins.

A pattern is a list of edges over vertices 0.., optionally with vertex labels. The
compiler picks an order of the vertices with many edges back, breaks symmetry by
inequalities from the pattern's automorphisms, and emits one inner join for each
vertex, a semi join for each further edge back and, for induced matches, an anti
join for each pair that must not be an edge. Each subgraph matches once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS: dict[str, list[tuple[int, int]]] = {
    "edge": [(0, 1)],
    "wedge": [(0, 1), (1, 2)],
    "triangle": [(0, 1), (1, 2), (0, 2)],
    "path4": [(0, 1), (1, 2), (2, 3)],
    "star3": [(0, 1), (0, 2), (0, 3)],
    "rectangle": [(0, 1), (1, 2), (2, 3), (0, 3)],
    "tailed_triangle": [(0, 1), (1, 2), (0, 2), (2, 3)],
    "diamond": [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)],
    "clique4": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)],
    "pentagon": [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)],
    "house": [(0, 1), (1, 2), (2, 3), (0, 3), (0, 4), (1, 4)],
}


@dataclass(frozen=True)
class Plan:
    """Order of the vertices; by place, edges back, pairs that aren't edges of the pattern and those that must not be edges; and
    inequalities (less, greater) by place."""

    order: tuple[int, ...]
    back: tuple[tuple[int, ...], ...]
    apart: tuple[tuple[int, ...], ...]
    banned: tuple[tuple[int, ...], ...]
    less: tuple[tuple[int, int], ...]


def automorphisms(n: int, edges: set[frozenset[int]], labels: Sequence | None = None, apart: set[frozenset[int]] = frozenset()) -> list[tuple[int, ...]]:
    kept = lambda p, pairs: all(frozenset(p[x] for x in e) in pairs for e in pairs)
    return [p for p in permutations(range(n)) if (labels is None or all(labels[p[i]] == labels[i] for i in range(n))) and kept(p, edges) and kept(p, apart)]


def compile_pattern(pattern: Sequence[tuple[int, int]], labels: Sequence | None = None, apart: Sequence[tuple[int, int]] = ()) -> Plan:
    """``apart`` are pairs of the pattern that must not be edges."""
    edges, never = {frozenset(e) for e in pattern}, {frozenset(e) for e in apart}
    if edges & never:
        raise ValueError("a pair is an edge and must not be one")
    n = 1 + max(max(e) for e in pattern)
    if any(len(e) != 2 for e in edges) or set().union(*edges) != set(range(n)):
        raise ValueError("a pattern has edges between different vertices, numbered from 0 without gaps")
    degree = [sum(v in e for e in edges) for v in range(n)]
    order = [max(range(n), key=lambda v: degree[v])]
    while len(order) < n:
        links = {v: sum(frozenset((v, u)) in edges for u in order) for v in range(n) if v not in order}
        best = max(links, key=lambda v: (links[v], degree[v], -v))
        if not links[best]:
            raise ValueError("the pattern isn't connected")
        order.append(best)
    place = {v: i for i, v in enumerate(order)}
    back = tuple(tuple(place[u] for u in order[:i] if frozenset((u, v)) in edges) for i, v in enumerate(order))
    free = tuple(tuple(place[u] for u in order[:i] if frozenset((u, v)) not in edges) for i, v in enumerate(order))
    banned = tuple(tuple(place[u] for u in order[:i] if frozenset((u, v)) in never) for i, v in enumerate(order))
    group, less = automorphisms(n, edges, labels, never), []
    for v in order:  # fix one vertex after the other to the least of its orbit
        less += [(place[v], place[u]) for u in sorted({p[v] for p in group} - {v})]
        group = [p for p in group if p[v] == v]
    return Plan(tuple(order), back, free, banned, tuple(less))


def match(edges: DataFrame, pattern: str | Sequence[tuple[int, int]], induced: bool = False, vertices: DataFrame | None = None, labels: Sequence | None = None, apart: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """One row (v0, v1, ..) per subgraph of an undirected graph (both directions in ``edges``) that matches.

    ``labels`` gives each pattern vertex a label of ``vertices(v, label)``; None leaves one free. ``apart`` are pairs of the
    pattern that must not be edges; ``induced`` says so of all pairs that aren't its edges.
    """
    if isinstance(pattern, str):
        if pattern not in PATTERNS:
            raise ValueError(f"unknown pattern {pattern}")
        pattern = PATTERNS[pattern]
    plan = compile_pattern(pattern, labels, apart)
    e = edges.select("src", "dst")

    def labelled(df: DataFrame, place: int) -> DataFrame:
        label = None if labels is None else labels[plan.order[place]]
        return df if label is None else df.join(vertices.where(F.col("label") == label).select(F.col("v").alias(f"p{place}")), f"p{place}", "left_semi")

    def bounded(df: DataFrame, place: int) -> DataFrame:
        tests = [F.col(f"p{a}") < F.col(f"p{b}") for a, b in plan.less if max(a, b) == place]
        return df.where(reduce(lambda x, y: x & y, tests)) if tests else df

    rows = labelled(labelled(bounded(e.select(F.col("src").alias("p0"), F.col("dst").alias("p1")), 1), 0), 1)
    for i in range(2, len(plan.order)):
        first, *others = plan.back[i]
        rows = rows.join(e.select(F.col("src").alias(f"p{first}"), F.col("dst").alias(f"p{i}")), f"p{first}")
        different = [F.col(f"p{i}") != F.col(f"p{j}") for j in plan.apart[i]]
        rows = bounded(rows.where(reduce(lambda x, y: x & y, different)) if different else rows, i)
        rows = labelled(rows, i)
        for j in others:
            rows = rows.join(e.select(F.col("src").alias(f"p{j}"), F.col("dst").alias(f"p{i}")), [f"p{j}", f"p{i}"], "left_semi")
        for j in plan.apart[i] if induced else plan.banned[i]:
            rows = rows.join(e.select(F.col("src").alias(f"p{j}"), F.col("dst").alias(f"p{i}")), [f"p{j}", f"p{i}"], "left_anti")
    place = {v: i for i, v in enumerate(plan.order)}
    return rows.select(*[F.col(f"p{place[v]}").alias(f"v{v}") for v in range(len(place))])


def count_pattern(edges: DataFrame, pattern: str | Sequence[tuple[int, int]], induced: bool = False, **options) -> DataFrame:
    """(total): number of subgraphs that match."""
    return match(edges, pattern, induced, **options).agg(F.count("*").alias("total"))


def rectangle_count(edges: DataFrame) -> DataFrame:
    """(total) of non-induced rectangles: pairs of wedges over the same two ends; nothing is listed."""
    from graphspark.operators.twohop import four

    return four(edges, whole=False).select(F.col("all4").alias("total"))


def diamond_count(edges: DataFrame) -> DataFrame:
    """(total) of non-induced diamonds: pairs of triangles on an edge."""
    from graphspark.operators.motifs import edge_triangles

    return edge_triangles(edges).agg(F.coalesce(F.sum(F.col("tri") * (F.col("tri") - 1) / 2).cast("long"), F.lit(0).cast("long")).alias("total"))
