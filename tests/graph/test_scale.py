"""That work is dealt over tasks by its size, and that this changes no result."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphspark import session
from graphspark.plans import datasets

RNG = random.Random(4)


def test_pairs_of_orders_are_counted_over_as_many_tasks_as_they_ask_for(spark, tmp_path, monkeypatch):
    lines = [(o, RNG.randrange(40)) for o in range(300) for _ in range(RNG.randrange(1, 6))] + [(None, 1), (None, 2), (5, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = {}
    for o, p in lines:
        if o is not None and p is not None:
            orders.setdefault(o, set()).add(p)
    count = {}
    for parts in orders.values():
        for pair in combinations(sorted(parts), 2):
            count[pair] = count.get(pair, 0) + 1
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    for least in (1, 2):
        found = datasets.common_order_edges(spark, str(tmp_path), least).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.u, r.v) for r in found) == sorted(p for p, n in count.items() if n >= least)
        assert len({r.task for r in found}) > 8  # the session has 4 partitions a shuffle


def random_graph(n, m, hub=None):
    pairs = {tuple(sorted(RNG.sample(range(n), 2))) for _ in range(m)} | ({tuple(sorted((hub, v))) for v in range(n) if v != hub} if hub is not None else set())
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return sorted(pairs), near


@pytest.mark.parametrize("hub", [None, 3])
def test_triangles_and_cliques_by_blocks(spark, monkeypatch, hub):
    from graphspark.operators import blocks, motifs

    pairs, near = random_graph(40, 300, hub)
    edges = spark.createDataFrame([(a * 10**9 - 7, b * 10**9 - 7) for a, b in pairs] + [(b * 10**9 - 7, a * 10**9 - 7) for a, b in pairs], "src long, dst long")
    whole = {k: [c for c in combinations(range(40), k) if all(b in near[a] for a, b in combinations(c, 2))] for k in (3, 4, 5)}
    back = lambda v: (v + 7) // 10**9
    monkeypatch.setattr(blocks, "HUB", 15)
    found = blocks.closed(edges, "rows", task_edges=60).collect()  # six colors
    assert sorted(tuple(map(back, sorted(r))) for r in found) == whole[3]
    assert sum(r.n for r in blocks.closed(edges, "count", task_edges=60).collect()) == len(whole[3])
    assert {back(r.v): r.triangles for r in motifs.triangles_per_vertex(edges).collect()} == {v: n for v in range(40) if (n := sum(v in c for c in whole[3]))}
    assert {(back(r.src), back(r.dst)): r.tri for r in motifs.edge_triangles(edges).collect()} == {(a, b): len(near[a] & near[b]) for a, b in pairs}
    for k in (4, 5):
        assert sorted(tuple(map(back, sorted(r))) for r in blocks.cliques(edges, k, task_edges=60).collect()) == whole[k]
        counted = motifs.clique_count(edges, k)
        assert counted.first()[0] == len(whole[k]) > 0
        assert "Join" not in counted._jdf.queryExecution().toString()  # no wedge is shuffled


def test_graphs_without_triangles(spark):
    from graphspark.operators import motifs

    for rows in ([], [(1, 2), (2, 1), (2, 3), (3, 2)]):
        edges = spark.createDataFrame(rows, "src long, dst long")
        assert [motifs.clique_count(edges, k).first()[0] for k in (3, 4)] == [0, 0]
        assert motifs.cliques(edges, 4).count() == motifs.triangles_per_vertex(edges).count() == 0


def test_matrix_product_is_dealt_by_its_products(spark, monkeypatch):
    from graphspark.functions import reductions

    a = {(RNG.randrange(9), RNG.randrange(9)): float(RNG.randrange(1, 5)) for _ in range(50)}
    want = {}
    for (i, k), x in a.items():
        for (l, j), y in a.items():
            if k == l:
                want[i, j] = want.get((i, j), 0.0) + x * y
    m = spark.createDataFrame([(*k, v) for k, v in a.items()], "row long, col long, value double")
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    found = reductions.matmul(m, m).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.row, r.col): r.value for r in found} == want
    assert len({r.task for r in found}) > 4  # the session has 4 partitions a shuffle


@pytest.mark.parametrize("both_ways", [False, True])
def test_wedge_patterns_meet_a_kind_of_center_once(spark, both_ways):
    from graphspark.operators import fsm

    pairs, near = random_graph(25, 60)
    label = {v: v % 3 for v in range(25)}
    images = {}
    for c in near:
        for a in near[c]:
            for b in near[c] - {a}:
                if label[a] <= label[b]:
                    for at, v in enumerate((c, a, b)):
                        images.setdefault((label[c], label[a], label[b]), (set(), set(), set()))[at].add(v)
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs] * both_ways, "src long, dst long")
    found = fsm.wedge_pattern_support(edges, spark.createDataFrame(list(label.items()), "v long, label int"), both_ways=both_ways)
    assert sorted(map(tuple, found.collect())) == sorted((*k, min(map(len, x))) for k, x in images.items())
    assert "Expand" not in found._jdf.queryExecution().toString()  # no row for each of several distinct counts


def test_edges_of_a_list_are_made_one_over_as_many_tasks_as_they_ask_for(spark, tmp_path, monkeypatch):
    from graphspark.sources import convert, readers

    pairs = [(RNG.randrange(30), RNG.randrange(30)) for _ in range(400)]
    (tmp_path / "g.el").write_text("".join(f"{a} {b}\n" for a, b in pairs))
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    convert.convert(spark, f"{tmp_path}/g.el", f"{tmp_path}/both", "el", "sel")
    found = readers.load_graph(spark, f"{tmp_path}/both", "el").edges.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.src, r.dst) for r in found) == sorted({e for a, b in pairs if a != b for e in ((a, b), (b, a))})
    assert len({r.task for r in found}) > 4  # the session has 4 partitions a shuffle


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_ratings_of_a_user_solved_at_once(n):
    import numpy as np

    from graphspark.operators import factor

    draw = np.random.default_rng(n)
    x, y, r, lam, eta = draw.normal(size=5), draw.normal(size=(n, 5)), draw.normal(size=n), 0.05, 0.03
    got = factor._user_block(x, y.copy(), r, lam, eta)
    own, items, errors = x, [], []
    for t in range(n):
        d = r[t] - own @ y[t]
        errors.append(d)
        own, new = own + eta * (-lam * own + y[t] * d), y[t] + eta * (-lam * y[t] + own * d)
        items.append(new)
    for a, b in zip(got, (own, np.array(items), np.array(errors)), strict=True):
        assert np.allclose(a, b, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("hub", [None, 3])
@pytest.mark.parametrize("leaf_edges", [None, 300])
def test_rectangles_and_motifs_by_two_steps(spark, monkeypatch, hub, leaf_edges):
    from graphspark.operators import blocks, motifs, patterns, twohop

    pairs, near = random_graph(40, 260, hub)
    far = lambda v: v * 10**9 - 7
    edges = spark.createDataFrame([(far(a), far(b)) for a, b in pairs] + [(far(b), far(a)) for a, b in pairs], "src long, dst long")
    if leaf_edges:
        monkeypatch.setattr(blocks, "CHUNK", 50)
        monkeypatch.setattr(twohop, "CHUNK", 50)
        monkeypatch.setattr(twohop, "HUB", 15)
        monkeypatch.setattr(twohop, "MARKS", 100)
    names = {(1, 1, 2, 2): "path4", (1, 1, 1, 3): "star3", (2, 2, 2, 2): "rectangle", (1, 2, 2, 3): "tailed_triangle", (2, 2, 3, 3): "diamond", (3, 3, 3, 3): "clique4"}
    want = dict.fromkeys(names.values(), 0)
    for s in combinations(range(40), 4):
        name = names.get(tuple(sorted(len(near[v] & set(s)) for v in s)))  # with no vertex of degree 0 these degrees are of connected graphs
        if name:
            want[name] += 1
    total = sum(n * (n - 1) // 2 for a, b in combinations(range(40), 2) if (n := len(near[a] & near[b]))) // 2
    found = twohop.four(edges, leaf_edges=leaf_edges)
    assert "Join" not in found._jdf.queryExecution().toString()  # no wedge is shuffled
    assert found.first().all4 == patterns.rectangle_count(edges).first()[0] == total > 0
    monkeypatch.setattr(twohop, "LEAF_EDGES", leaf_edges or twohop.LEAF_EDGES)
    assert {r.motif: r.total for r in motifs.motifs_by_formula(edges, 4).collect()} == want


def test_leaves_are_halved_until_they_hold_little():
    from graphspark.operators import twohop

    loads = {(level, i): 100 >> (twohop.LEVELS - level) for level in range(twohop.LEVELS + 1) for i in range(40)}
    assert twohop._leaves(loads, 40, 100).tolist() == [i >> 4 for i in range(40)]
    assert twohop._leaves(loads, 40, 30).tolist() == [i >> 2 for i in range(40)]
    assert twohop._leaves(loads, 37, 1).tolist() == list(range(37))


@pytest.mark.parametrize("hubs", [{}, {3: 1, 20: 2}])
@pytest.mark.parametrize("chunk", [7, 60, 1 << 20])
def test_a_leaf_counts_a_bounded_number_of_wedges_at_a_time(monkeypatch, hubs, chunk):
    import numpy as np
    import pyarrow as pa

    from graphspark.operators import blocks, twohop

    pairs, near = random_graph(40, 260, 3)
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    monkeypatch.setattr(twohop, "CHUNK", chunk)
    monkeypatch.setattr(twohop, "MARKS", chunk)
    u, w = np.array(pairs + [(b, a) for a, b in pairs]).T
    bounds, leaf_of = np.array([10, 25]), np.array([0, 1, 0])
    out = {n: 0 for n in twohop.NAMES}
    for leaf in (0, 1):  # every list whole, in any order
        batch = pa.record_batch([pa.array([leaf], pa.int32()), pa.array([blocks.pack(u, w)], pa.binary())], ["t", "packed"])
        for row in next(twohop._solve(bounds, leaf_of, hubs, True)([batch])).to_pylist():
            out = {n: out[n] + row[n] for n in out}
    t = {(a, b): len(near[a] & near[b]) for a, b in pairs}
    sides = {(a, b): (len(near[a]) - n - 1, len(near[b]) - n - 1) for (a, b), n in t.items()}
    assert out == {
        "all4": sum(n * (n - 1) // 2 for a, b in combinations(range(40), 2) if (n := len(near[a] & near[b]))) // 2,
        "k4": sum(all(b in near[a] for a, b in combinations(s, 2)) for s in combinations(range(40), 4)),
        "tt": sum(n * (n - 1) // 2 for n in t.values()),
        "ts": sum(n * sum(sides[e]) for e, n in t.items()),
        "ss": sum(x * y for x, y in sides.values()),
        "s2": sum(x * (x - 1) + y * (y - 1) for x, y in sides.values()),
    }


def test_ranks_move_sums_by_range_and_not_edges(spark, monkeypatch):
    import numpy as np

    from graphspark.graph import Graph
    from graphspark.operators import ranking, vectors

    monkeypatch.setattr(vectors, "RANGE_EDGES", 20)  # many ranges, and rows of at most 20 edges
    n = 60
    pairs = sorted({(RNG.randrange(30), RNG.randrange(30)) for _ in range(300)} | {(3, v) for v in range(40)})
    far = lambda v: v * 10**9 - 7
    g = Graph(spark.createDataFrame([(far(a), far(b)) for a, b in pairs], "src long, dst long"), spark.createDataFrame([(far(v),) for v in range(n)], "v long"), True)
    out = [sum(a == v for a, _ in pairs) for v in range(n)]
    score = [1 / n] * n
    for _ in range(4):
        into = [0.0] * n
        for a, b in pairs:
            into[b] += score[a] / out[a]
        score = [0.15 / n + 0.85 * x for x in into]
    want = {far(v): pytest.approx(x, rel=1e-9) for v, x in enumerate(score)}
    assert {r.v: r.score for r in ranking.pagerank(g, tolerance=1e-15, iterations=4)[0].collect()} == want
    assert {r.v: r.score for r in ranking.pagerank_delta(g, tolerance=0.0, iterations=4)[0].collect()} == want
    pushing = vectors.Pushing(g, "test", lambda k: (np.ones(k), np.zeros(0)), lambda a, _: a)
    assert pushing.edges.count() >= len(pairs) / 20 and len(pushing.bounds) > 4  # a piece is a row


def strong(spark, edges, vertices, **more):
    from graphspark.graph import Graph
    from graphspark.operators import connectivity

    g = Graph(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(v,) for v in vertices], "v long"), True)
    return connectivity.strongly_connected_components(g, **more)


def test_searches_for_strong_components_grow_slower_than_a_chain_of_them(spark):
    n = 14
    edges = [(3 * c + i, 3 * c + (i + 1) % 3) for c in range(n) for i in range(3)] + [(3 * c, 3 * c + 3) for c in range(n - 1)]
    spark.sparkContext.setJobGroup("strong", "strong")
    try:
        found = sorted(tuple(r) for r in strong(spark, edges, range(3 * n)).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("strong"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == [(v, v - v % 3) for v in range(3 * n)]
    assert jobs < 20 * n, jobs


@pytest.mark.parametrize("trims", [0, 2])
def test_strong_components_by_ranges(spark, trims):
    from graphspark.operators import connectivity

    rng = random.Random(trims)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(24)]
    edges = [(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(36))]
    edges += edges[:5] + [(ids[0], ids[0]), (ids[1], 5), (5, ids[1]), (5, ids[2])]  # duplicates, a loop, an end that's no vertex
    vertices = set(ids)
    kept = [(a, b) for a, b in edges if {a, b} <= vertices]
    want = {v: v for v in vertices} | dict(connectivity._tarjan(*map(list, zip(*kept, strict=True))).itertuples(index=False))
    assert 1 < len({c for v, c in want.items() if c != v}) or max(map(list(want.values()).count, want.values())) > 2
    for found in (strong(spark, edges, ids, trims=trims).collect(), strong(spark, edges, ids, trims=trims, local_edges=20).collect()):
        assert sorted(tuple(r) for r in found) == sorted(want.items())


def test_labels_are_followed_inside_a_range():
    import numpy as np

    from graphspark.operators.strong import NONE, follow, mixed

    n = 200  # a chain with a way back: the least label comes everywhere
    to = np.array([*range(1, n), 0], np.int32)
    label, fresh = np.full(n, NONE), np.zeros(n, bool)
    label[[5, 9]], fresh[[5, 9]] = [7, 3], True
    follow(label, fresh, np.arange(n + 1), to)
    assert (label == 3).all() and fresh.all()
    ids = np.array([*range(-1000, 1000), -(2**63), 2**63 - 1])
    assert len(np.unique(mixed(ids))) == len(ids)
