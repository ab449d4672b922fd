"""Connected components: weak, by sampling first (Afforest), and strong; k-cores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph, dedup, symmetrize
from graphspark.operators import strong
from graphspark.session import dealt, loop_materialize, loop_measured, materialize, measured, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, to links of the same components, closer to stars around the least node."""
    if large:  # every neighbour above a node goes to the least of the node and its neighbours
        pairs = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every neighbour below a node, and the node, go to the least of them
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def component_labels(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has a link, by alternating large-star and small-star steps.

    ``links`` are two columns of one orderable type, ``a`` and ``b``; the label is the
    least node reachable. The rounds are logarithmic in the longest chain; each writes
    its links to the shared folder, and nothing but their fingerprint is collected.
    """
    paths: list[str] = []
    now = loop_materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", paths)
    mark = None
    for _ in range(rounds):
        now = loop_materialize(_star(_star(now, True), False), "links", paths)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == mark:  # two independent sums over distinct links that don't change: a fixpoint
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def connected_components(g: Graph) -> DataFrame:
    """(v, component): the least vertex id of the weak component; edges count in both directions."""
    labels = component_labels(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.select("v").join(labels, F.col("v") == F.col("node"), "left").select("v", F.coalesce("label", "v").alias("component"))


def afforest(g: Graph, rounds: int = 2) -> DataFrame:
    """As ``connected_components``: the first ``rounds`` neighbours of each vertex are linked first, then only
    edges that leave the largest component so far."""
    both, links = dealt(dedup(symmetrize(g.edges.select("src", "dst"))), "src", tag="edges"), None
    # the least neighbour above the last one taken, so often: plain minima, however many neighbours a hub has
    taken = None
    for _ in range(rounds):
        rest = both if taken is None else both.join(taken.select("src", F.col("dst").alias("last")), "src").where("dst > last")
        taken = rest.groupBy("src").agg(F.min("dst").alias("dst"))
        links = taken if links is None else links.unionByName(taken)
    first = materialize(component_labels(links.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "afforest")
    giant = first.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("giant"))
    of = g.vertices.select("v").join(first, F.col("v") == F.col("node"), "left").select("v", F.coalesce("label", "v").alias("c"))
    a, b = of.select(F.col("v").alias("src"), F.col("c").alias("a")), of.select(F.col("v").alias("dst"), F.col("c").alias("b"))
    left = both.join(a, "src").join(b, "dst").where("a <> b").join(giant, F.col("a") == F.col("giant"), "left_anti").select("a", "b")
    merged = component_labels(left)
    return of.join(merged, F.col("c") == F.col("node"), "left").select("v", F.coalesce("label", "c").alias("component"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: Edges that one task may take by default: none, so that every graph goes through the distributed rounds. A caller that knows
#: what a task holds may have the rest of a graph finished in one.
LOCAL_EDGES = 0


def _in_one_task(edges: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` over all edges in a single task; callers check their number first."""
    return edges.select("src", "dst", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda pdf: solve(pdf["src"].tolist(), pdf["dst"].tolist()), schema)


def _tarjan(src: list[int], dst: list[int]) -> pd.DataFrame:
    """(v, component) of a graph in memory: Tarjan's algorithm without recursion."""
    after: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    inside: set[int] = set()
    out: list[tuple[int, int]] = []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        inside.add(root)
        while work:
            v, rest = work[-1]
            for u in rest:
                if u not in index:
                    index[u] = low[u] = len(index)
                    stack.append(u)
                    inside.add(u)
                    work.append((u, iter(after[u])))
                    break
                if u in inside:
                    low[v] = min(low[v], index[u])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                    inside.difference_update(members)
                    least = min(members)
                    out += [(u, least) for u in members]
    return pd.DataFrame(out, columns=["v", "component"])


def _peel(src: list[int], dst: list[int]) -> pd.DataFrame:
    """(v, core) of an undirected graph in memory, by buckets of degrees."""
    near: dict[int, set[int]] = {}
    for a, b in zip(src, dst, strict=True):
        near.setdefault(a, set()).add(b)
    degree = {v: len(x) for v, x in near.items()}
    buckets: list[set[int]] = [set() for _ in range(max(degree.values(), default=0) + 1)]
    for v, d in degree.items():
        buckets[d].add(v)
    core, k, done = {}, 0, 0
    while done < len(near):
        k = max(0, k - 1)
        while not buckets[k]:
            k += 1
        v = buckets[k].pop()
        core[v] = max(k, core.get("top", 0))
        core["top"] = core[v]
        done += 1
        for u in near[v]:
            near[u].discard(v)
            if u not in core:
                d = len(near[u])
                buckets[d + 1].discard(u)
                buckets[d].add(u)
    core.pop("top", None)
    return pd.DataFrame(list(core.items()), columns=["v", "core"])


def strongly_connected_components(g: Graph, trims: int = 2, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, component): least vertex id of the strong component, by labels that travel both ways along packed edges (``strong``).

    Before a search, vertices without in- or out-edges are components by themselves, and so, ``trims`` times in a range, are those
    that have lost them by that. With ``local_edges``, one task finishes what has no more edges than that.
    """
    return strong.components(g, trims, local_edges, lambda edges: _in_one_task(edges, _tarjan, "v long, component long"))


def k_core(g: Graph, k: int) -> DataFrame:
    """Vertices of the maximal subgraph of an undirected graph in which every degree is at least k."""
    paths: list[str] = []
    edges, size = loop_measured(g.edges.select("src", "dst"), "core", paths)
    n = size["n"]
    while True:
        keep = edges.groupBy("src").count().where(F.col("count") >= k).select(F.col("src").alias("v"))
        edges, size = loop_measured(edges.join(keep, edges["src"] == keep["v"], "left_semi").join(keep, edges["dst"] == keep["v"], "left_semi"), "core", paths)
        left = size["n"]
        if left == n:
            return edges.select(F.col("src").alias("v")).distinct()
        n = left


def core_numbers(g: Graph, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, core): the largest k whose k-core holds the vertex, peeled level by level; with ``local_edges``, a graph of no more
    directed edges than that is peeled in one task."""
    paths: list[str] = []
    done_paths: list[str] = []
    done: list[DataFrame] = [g.vertices.select("v").join(g.edges.select(F.col("src").alias("v")).distinct(), "v", "left_anti").select("v", F.lit(0).alias("core"))]
    edges, size = loop_measured(g.edges.select("src", "dst"), "peel", paths)
    n = size["n"]
    if n and n <= local_edges:
        return done[0].unionByName(_in_one_task(edges, _peel, "v long, core int"))
    k = 1
    while n:
        # The vertices of degree k or less go, and with them their edges; what has lost all its edges by that goes along.
        degree = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
        low, found = measured(degree.where(F.col("d") <= k).select("v", F.lit(k).alias("core")), "peeled")
        if not found["n"]:
            k = max(k + 1, degree.agg(F.min("d")).first()[0])
            release(low)
            continue
        kept = edges.join(low, edges["src"] == low["v"], "left_anti")
        gone, size = loop_measured(kept.join(low, kept["dst"] == low["v"], "left_anti"), "peel", paths)
        lost = materialize(kept.select(F.col("src").alias("v")).distinct().join(gone.select(F.col("src").alias("v")).distinct(), "v", "left_anti").select("v", F.lit(k).alias("core")), "peeled")
        done += [low, lost]
        edges, n = gone, size["n"]
        if len(done) > COMPACT:
            whole = loop_materialize(_union(done), "cores", done_paths)
            release(*done)
            done = [whole]
    return _union(done)


#: Tables of peeled vertices that are kept apart before they are written as one.
COMPACT = 24
