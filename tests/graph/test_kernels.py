"""Kernels on tiny graphs against plain Python."""

import heapq
import random
from collections import Counter, defaultdict, deque
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from graphspark import graph as G
from graphspark import session
from graphspark.operators import coloring, connectivity, factor, fsm, linalg, motifs, patterns, ranking, sets, spanning, traversal


def make(spark, edges, n, directed=True):
    cols = "src long, dst long" + (", weight long" if edges and len(edges[0]) == 3 else "")
    return G.Graph.of(spark.createDataFrame(edges, cols), spark.range(n).select(F.col("id").alias("v")), directed)


RNG = random.Random(5)
DIRECTED = sorted({(RNG.randrange(14), RNG.randrange(14)) for _ in range(40)})
UNDIRECTED = sorted({(RNG.randrange(12), RNG.randrange(12)) for _ in range(34)})


@pytest.fixture(scope="module")
def directed(spark):
    return make(spark, DIRECTED, 16)


@pytest.fixture(scope="module")
def undirected(spark):
    return make(spark, UNDIRECTED, 14, directed=False)


def near(edges, both=False):
    out = defaultdict(set)
    for a, b, *_ in edges:
        if a != b:
            out[a].add(b)
            if both:
                out[b].add(a)
    return out


def distances(adj, source):
    d, todo = {source: 0}, deque([source])
    while todo:
        v = todo.popleft()
        for u in adj[v]:
            if u not in d:
                d[u] = d[v] + 1
                todo.append(u)
    return d


@pytest.mark.parametrize("mode", ["push", "pull", "auto"])
def test_bfs(directed, mode):
    assert {r.v: r.depth for r in traversal.bfs(directed, 0, mode).collect()} == distances(near(DIRECTED), 0)
    assert {r.v for r in traversal.bfs_all(directed, 0).where("depth is null").collect()} == set(range(16)) - set(distances(near(DIRECTED), 0))


def test_dealt_edges(spark, directed, monkeypatch):
    """Edges in buckets: the same results, and only the other side of a join is moved."""
    monkeypatch.setattr(session, "SMALL", 0)
    for mode in ("push", "pull", "auto"):
        assert {r.v: r.depth for r in traversal.bfs(directed, 0, mode).collect()} == distances(near(DIRECTED), 0)
    test_sssp(spark, None)
    test_betweenness(directed)
    test_pagerank(spark)
    own = session.dealt(directed.edges, "src")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = own.join(spark.range(5).withColumnRenamed("id", "src"), "src")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("delta", [None, 3])
def test_sssp(spark, delta):
    edges = [(a, b, 1 + (7 * a + 3 * b) % 9) for a, b in DIRECTED] + [(0, 5, 9), (0, 5, 2)]
    want, todo = {}, [(0, 0)]
    while todo:
        d, v = heapq.heappop(todo)
        if v not in want:
            want[v] = d
            for a, b, w in edges:
                if a == v and a != b:
                    heapq.heappush(todo, (d + w, b))
    assert {r.v: r.distance for r in traversal.sssp(make(spark, edges, 16), 0, delta).collect()} == want


def test_betweenness(directed):
    adj, depth = near(DIRECTED), distances(near(DIRECTED), 0)
    order = sorted(depth, key=depth.get)
    sigma, delta = Counter({0: 1}), Counter()
    for v in order:
        for u in adj[v]:
            if depth[u] == depth[v] + 1:
                sigma[u] += sigma[v]
    for v in reversed(order):
        delta[v] = sum(sigma[v] / sigma[u] * (1 + delta[u]) for u in adj[v] if depth[u] == depth[v] + 1)
    top = max(delta.values())
    for r in traversal.betweenness(directed, 0).collect():
        assert r.score == pytest.approx(delta[r.v] / top) and r.paths == sigma[r.v]


def test_pagerank(spark):
    g = make(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 0), (2, 3)], 4)
    scores, errors = ranking.pagerank(g)
    assert errors[-1] < 1e-4 <= errors[-2] and sum(r.score for r in scores.collect()) == pytest.approx(1)
    assert ranking.pagerank_residual(g, scores) < 1e-4
    exact = {r.v: r.score for r in ranking.pagerank(g, tolerance=1e-10)[0].collect()}
    approximate = {r.v: r.score for r in ranking.pagerank_delta(g, tolerance=1e-5)[0].collect()}
    assert approximate == pytest.approx(exact, abs=1e-3)


def test_pagerank_errors_are_the_published_ones(spark):
    """Four vertices and eight edges, and the errors of fifteen steps that are published for them (fixed values)."""
    g = make(spark, [(1, 0), (2, 0), (3, 0), (2, 1), (3, 1), (0, 2), (0, 3), (2, 3)], 4)
    want = [0.354167, 0.240833, 0.085295, 0.043501, 0.035948, 0.020080, 0.007204, 0.005053, 0.003801, 0.001311, 0.000713, 0.000599, 0.000314, 0.000118, 0.000083]
    assert [round(e, 6) for e in ranking.pagerank(g)[1]] == want


def test_components(directed, undirected):
    for g, edges, n in ((directed, DIRECTED, 16), (undirected, UNDIRECTED, 14)):
        adj = near(edges, both=True)
        want = {v: min(distances(adj, v)) for v in range(n)}
        assert {r.v: r.component for r in connectivity.connected_components(g).collect()} == want
        assert {r.v: r.component for r in connectivity.afforest(g).collect()} == want


def test_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in connectivity.component_labels(chain).collect()} == {0}


def test_strong_components(directed):
    adj = near(DIRECTED)
    reach = {v: set(distances(adj, v)) for v in range(16)}
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in range(16)}
    for local in (0, 10**6):  # by rounds, and in one task
        assert {r.v: r.component for r in connectivity.strongly_connected_components(directed, local_edges=local).collect()} == want


def test_cores(undirected):
    adj = {v: set(u) for v, u in near(UNDIRECTED, both=True).items()}
    want = {v: 0 for v in range(14)}
    k = 1
    while any(adj.values()):
        low = [v for v in adj if 0 < len(adj[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            want[v] = k
            for u in adj.pop(v):
                if u in adj:
                    adj[u].discard(v)
                    if not adj[u] and u not in low:
                        want[u] = k
    for local in (0, 10**6):
        assert {r.v: r.core for r in connectivity.core_numbers(undirected, local).collect()} == want
    assert {r.v for r in connectivity.k_core(undirected, 3).collect()} == {v for v, c in want.items() if c >= 3}


def test_spanning_forest(spark):
    edges = [(a, b, 1 + (a * b) % 5) for a, b in UNDIRECTED]
    parent = list(range(14))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    total = n = 0
    for w, a, b in sorted((w, a, b) for a, b, w in edges if a != b):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total, n = total + w, n + 1
    r = spanning.forest_summary(make(spark, edges, 14)).first()
    assert (r.weight, r.edges, r.components) == (total, n, 14 - n)


def test_coloring(undirected):
    colors = coloring.color(undirected)
    assert coloring.conflicts(undirected, colors).count() == 0 and colors.where("color is null").count() == 0
    assert colors.agg(F.max("color")).first()[0] <= max(len(x) for x in near(UNDIRECTED, both=True).values())


def test_linear_algebra(spark, undirected, directed):
    x = directed.vertices.select("v", (F.col("v") + 1.0).alias("value"))
    into = defaultdict(set)
    for a, b in DIRECTED:
        if a != b:
            into[b].add(a)
    assert {r.v: r.value for r in linalg.spmv(directed, x, y=x, weight=2.0).collect()} == {v: v + 1 + sum(2.0 * (u + 1) for u in into[v]) for v in range(16)}
    matrix = undirected.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(-1.0).alias("value"))
    diagonal = undirected.vertices.select("v", F.when(F.col("v") == 13, 0.0).otherwise(20.0).alias("value"))
    b = undirected.vertices.select("v", F.lit(1.0).alias("value"))
    colors = coloring.color(undirected).collect()
    adj, want = near(UNDIRECTED, both=True), {v: 0.0 for v in range(14)}
    by_color = sorted({r.color for r in colors})
    for c in by_color + by_color[::-1]:
        want |= {r.v: (1 + sum(want[u] for u in adj[r.v])) / 20 for r in colors if r.color == c and r.v != 13}
    got = linalg.symmetric_gauss_seidel(matrix, diagonal, b, spark.createDataFrame(colors))
    assert {r.v: r.value for r in got.collect()} == pytest.approx(want)
    assert linalg.residual(matrix, diagonal, b, got).where("v <> 13").agg(F.max(F.abs("value"))).first()[0] < 0.1


def test_factorization(spark):
    ratings = [(u, i, (u * 3 + i) % 7 / 7) for u in range(6) for i in range(4) if (u + i) % 5]
    df = spark.createDataFrame(ratings, "u long, i long, r double")
    users, items = (factor.initial_latents(spark.range(n).select("id"), k=4, value=0.05) for n in (6, 4))
    u, v = {a: [0.05] * 4 for a in range(6)}, {a: [0.05] * 4 for a in range(4)}
    total = 0.0
    for a, b, r in sorted(ratings):
        d = r - sum(x * y for x, y in zip(u[a], v[b], strict=True))
        total += d * d
        u[a], v[b] = [x + 0.01 * (-0.05 * x + y * d) for x, y in zip(u[a], v[b], strict=True)], [y + 0.01 * (-0.05 * y + x * d) for x, y in zip(u[a], v[b], strict=True)]
    out = factor.sgd_sequential(df, users, items, 0.05, 0.01, iterations=1).collect()
    assert {r.id: r.latent for r in out if r.side == "user"}[3] == pytest.approx(u[3]) and out[0].rmses[0] == pytest.approx((total / len(ratings)) ** 0.5)
    _, _, errors = factor.sgd_batch(df, users, items, 0.05, 0.05, epsilon=0.0, iterations=4)
    assert errors == sorted(errors, reverse=True) and errors[0] == pytest.approx(factor.rmse(df, users, items).first()[0])


def brute_count(edges, n, pattern, induced):
    adj, k = near(edges, both=True), 1 + max(max(e) for e in pattern)
    want = {frozenset(e) for e in pattern}
    found = set()
    for p in permutations(range(n), k):
        pairs = {frozenset((p[a], p[b])) for a, b in want}
        if all(y in adj[x] for x, y in map(tuple, pairs)) and (not induced or all((frozenset((a, b)) in want) or p[b] not in adj[p[a]] for a, b in combinations(range(k), 2))):
            found.add((frozenset(p), frozenset(pairs)))
    return len(found)


@pytest.mark.parametrize("induced", [False, True])
@pytest.mark.parametrize("name", ["triangle", "path4", "rectangle", "diamond", "tailed_triangle", "house", "pentagon"])
def test_patterns(undirected, name, induced):
    assert patterns.count_pattern(undirected.edges, name, induced).first().total == brute_count(UNDIRECTED, 12, patterns.PATTERNS[name], induced)


def test_motifs(undirected):
    for k in (3, 4):
        want = {name: brute_count(UNDIRECTED, 12, patterns.PATTERNS[name], True) for name in motifs.MOTIFS[k]}
        assert {r.motif: r.total for r in motifs.motifs(undirected.edges, k).collect()} == want
        assert {r.motif: r.total for r in motifs.motifs(undirected.edges, k, listed=True).collect()} == want
        assert {r.motif: r.total for r in motifs.motifs_by_formula(undirected.edges, k).collect()} == want
    adj = near(UNDIRECTED, both=True)
    five = {r.motif: r.total for r in motifs.motifs(undirected.edges, 5).collect()}
    inner = [{(a, b) for a, b in combinations(s, 2) if b in adj[a]} for s in combinations(range(12), 5)]
    connected = [e for s, e in zip(combinations(range(12), 5), inner, strict=True) if len(distances(near(e, both=True), s[0])) == 5]
    assert sum(five.values()) == len(connected) and all(int(m.split(";")[0]) >= 4 for m in five)
    assert sum(t for m, t in five.items() if m.startswith("4;")) == sum(len(e) == 4 for e in connected)
    assert patterns.rectangle_count(undirected.edges).first().total == brute_count(UNDIRECTED, 12, patterns.PATTERNS["rectangle"], False)
    assert patterns.diamond_count(undirected.edges).first().total == brute_count(UNDIRECTED, 12, patterns.PATTERNS["diamond"], False)


def test_pairs_that_must_not_be_edges(undirected):
    """A square one of whose diagonals must not be an edge, while the other may."""
    adj, found = near(UNDIRECTED, both=True), set()
    for a, b, c, d in permutations(range(12), 4):
        if b in adj[a] and c in adj[b] and d in adj[c] and a in adj[d] and c not in adj[a]:
            found.add((frozenset((a, c)), frozenset((b, d))))
    assert patterns.count_pattern(undirected.edges, [(0, 1), (1, 2), (2, 3), (0, 3)], apart=[(0, 2)]).first().total == len(found)
    with pytest.raises(ValueError):
        patterns.compile_pattern([(0, 1), (1, 2)], apart=[(0, 1)])


def test_numbers(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("label"), F.col("id").alias("v"))
    got = G.numbered(df, F.desc("label"), F.col("v")).collect()
    assert sorted((-r.label, r.v, r.number) for r in got) == [(-a, b, i) for i, (a, b) in enumerate(sorted(((i % 3, i) for i in range(500)), key=lambda x: (-x[0], x[1])))]
    g = G.Graph(spark.createDataFrame([(0, 1)], "src long, dst long"), df)
    assert {(r.label, r.v): r.position for r in G.label_index(g).collect()} == {(i % 3, i): i // 3 + 1 for i in range(500)}


def test_labels_of_edges_stay(spark):
    e = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (0, 1, 5), (2, 1, 7)], "src long, dst long, elabel int")
    both = G.Graph.of(e).undirected().edges
    assert sorted(map(tuple, both.collect())) == [(0, 1, 5), (0, 1, 6), (1, 0, 5), (1, 0, 6), (1, 2, 7), (2, 1, 7)]


def test_cliques(undirected):
    adj = near(UNDIRECTED, both=True)
    for k in (3, 4, 5):
        want = {s for s in combinations(range(12), k) if all(b in adj[a] for a, b in combinations(s, 2))}
        assert {tuple(sorted(r)) for r in motifs.cliques(undirected.edges, k).collect()} == want


def test_labelled_pattern(spark, undirected):
    labels = undirected.vertices.select("v", (F.col("v") % 2).cast("int").alias("label"))
    adj = near(UNDIRECTED, both=True)
    want = sum(1 for c in adj if c % 2 == 1 for a, b in combinations(sorted(adj[c]), 2) if a % 2 == 0 and b % 2 == 0)
    assert patterns.count_pattern(undirected.edges, "wedge", vertices=labels, labels=[0, 1, 0]).first().total == want


def test_bad_patterns():
    for bad in ([(0, 2)], [(0, 1), (2, 3)], [(0, 0)]):
        with pytest.raises(ValueError):
            patterns.compile_pattern(bad)


def test_frequent_subgraphs(spark, undirected):
    labels = undirected.vertices.select("v", (F.col("v") % 3).cast("int").alias("label"))
    found = {r.code: r.support for r in fsm.frequent_subgraphs(undirected.edges, labels, 3, 2).collect()}
    single = {f"{r.la},{r.lb}|0-1:0": r.support for r in fsm.edge_pattern_support(undirected.edges, labels).collect()}
    assert {c: s for c, s in found.items() if c.count("-") == 1} == {c: s for c, s in single.items() if s >= 2}
    wedges = sorted(r.support for r in fsm.wedge_pattern_support(undirected.edges, labels).collect() if r.support >= 2)
    assert sorted(s for c, s in found.items() if c.count("-") == 2) == wedges
    adj = near(UNDIRECTED, both=True)
    images = set()
    for a, b, c in permutations(range(12), 3):
        if (a % 3, b % 3, c % 3) == (0, 1, 2) and b in adj[a] and c in adj[a] and c in adj[b]:
            images.add((a, b, c))
    support = min((len({t[i] for t in images}) for i in range(3)), default=0)
    assert found.get("0,1,2|0-1:0 0-2:0 1-2:0", 0) == (support if support >= 2 else 0)


def test_set_algebra(spark):
    df = spark.createDataFrame([([1, 3, 5, 7], [3, 4, 5, 9])], "a array<long>, b array<long>")
    one = df.select(sets.intersection("a", "b", F.lit(5)), sets.intersection_count("a", "b", without=[F.lit(3)]), sets.difference("a", "b", F.lit(7)), sets.difference_count("a", "b", below=F.lit(7)), sets.bounded("a", F.lit(4)), sets.union("a", "b"), sets.contains("a", F.lit(3))).first()
    assert list(one) == [[3], 1, [1], 1, [1, 3], [1, 3, 4, 5, 7, 9], True]


def test_model(spark):
    g = make(spark, [(0, 1, 5), (0, 1, 3), (1, 1, 1), (2, 0, 4)], 5)
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 3), (2, 0, 4)]
    assert sorted(map(tuple, g.undirected().edges.collect())) == [(0, 1, 3), (0, 2, 4), (1, 0, 3), (2, 0, 4)] or g.undirected().edges.count() == 4
    assert {r.v: r.degree for r in G.out_degrees(g).collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0}
    und = make(spark, UNDIRECTED, 14, directed=False)
    new, ids = G.relabel_by_degree(und)
    adj = near(UNDIRECTED, both=True)
    want = {v: i for i, v in enumerate(sorted(range(14), key=lambda v: (len(adj[v]), v), reverse=True))}
    assert {r.v: r.new_id for r in ids.collect()} == want and new.edges.count() == und.edges.count()
    assert G.orient(und.edges).count() * 2 == und.edges.count()
    with pytest.raises(ValueError):
        G.check_degrees(make(spark, [(1, 1)], 3))
