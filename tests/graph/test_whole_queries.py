"""Queries on whole derived graphs: a small lineitem against plain Python."""

import random
from collections import Counter, defaultdict, deque
from itertools import combinations

import pytest

from graphspark.plans.queries import ORACLES, QUERIES

RNG = random.Random(9)
#: Orders of a few parts each; orders keep to a range of parts, so that there are several strong components.
ORDERS = [(o, [10 * (o % 4) + RNG.randrange(10) for _ in range(RNG.randrange(1, 6))] + ([10 * (o % 4) + 12] if o % 9 == 0 else [])) for o in range(40)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    lines = [(o, p, i + 1) for o, parts in ORDERS for i, p in enumerate(parts)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(p, p * 7 % 50) for p in range(60)], "p_partkey long, p_size int").write.parquet(f"{out}/part.parquet")
    return out


def rows(spark, sf, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf).collect())


def reach(adj, v):
    d, todo = {v: 0}, deque([v])
    while todo:
        x = todo.popleft()
        for y in adj[x]:
            if y not in d:
                d[y] = d[x] + 1
                todo.append(y)
    return d


def sequence():
    adj = defaultdict(set)
    for _, parts in ORDERS:
        for a, b in zip(parts, parts[1:], strict=False):
            if a != b:
                adj[a].add(b)
    return adj, {x for a in adj for x in (a, *adj[a])}


def test_strong_components_and_depths(spark, sf):
    adj, vertices = sequence()
    seen = {v: reach(adj, v) for v in vertices}
    component = {v: min(u for u in seen[v] if v in seen[u]) for v in vertices}
    sizes = Counter(Counter(component.values()).values())
    assert len(sizes) > 1 and max(sizes) > 2
    assert rows(spark, sf, "scc_labels") == sorted(component.items())
    assert rows(spark, sf, "scc_sizes") == sorted(sizes.items())
    depths = seen[min(adj)]
    assert {r.v: r.depth for r in QUERIES["bfs_pull_all"](spark, sf).collect()} == {v: depths.get(v) for v in vertices}


def induced(near, vertices, k):
    """Counter of (edges, sorted degrees) of the connected induced subgraphs of k vertices."""
    out = Counter()
    for s in combinations(sorted(vertices), k):
        inner = {v: near[v] & set(s) for v in s}
        if len(reach(inner, s[0])) == k:
            out[tuple(sorted(len(x) for x in inner.values()))] += 1
    return out


def test_generated_graphs_follow_the_tables(spark, sf):
    assert QUERIES["generated_rmat"](spark, sf).selectExpr("sum(vertices)").first()[0] == 64
    assert rows(spark, sf, "generated_uniform") == [(512, 0, 0)]


@pytest.mark.parametrize("name", ["scc_pairs_labels", "kcore", "mst_weight", "motif5", "fsm_k", "fsm_edge_labels", "symgs_sweep", "pagerank_delta", "set_algebra", "set_algebra_bounded", "labelled_common", "file_mtx", "file_mtx_weighted", "file_el", "file_wel", "file_gr", "file_metis", "file_adjacency", "file_labelled", "convert_cel", "convert_sel", "file_degrees"])
def test_queries_agree_with_their_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for table in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet/*.parquet')")
    own = QUERIES[name](spark, sf)
    names = sorted(own.columns)
    want = db.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, own.select(*names).collect())) == sorted(want)


def test_common_orders(spark, sf):
    near = defaultdict(set)
    for _, parts in ORDERS:
        for a, b in combinations(set(parts), 2):
            near[a].add(b)
            near[b].add(a)
    vertices = sorted(near)
    assert max(vertices) > 60 / 5  # not the lowest fifth alone
    cliques = {k: [c for c in combinations(vertices, k) if all(b in near[a] for a, b in combinations(c, 2))] for k in (3, 4)}
    cliques[5] = [(*c, v) for c in cliques[4] for v in vertices if v > c[-1] and all(v in near[u] for u in c)]
    for k in (3, 4, 5):
        assert cliques[k] and rows(spark, sf, f"clique{k}_count") == [(len(cliques[k]),)]
    assert rows(spark, sf, "clique4_list") == cliques[4]
    assert rows(spark, sf, "triangles_per_vertex") == sorted(Counter(v for c in cliques[3] for v in c).items())
    three, four = induced(near, vertices, 3), induced(near, vertices, 4)
    want = [("triangle", three[2, 2, 2]), ("wedge", three[1, 1, 2])]
    assert rows(spark, sf, "motif3") == rows(spark, sf, "motif3_formula") == want
    degrees = {"path4": (1, 1, 2, 2), "star3": (1, 1, 1, 3), "rectangle": (2, 2, 2, 2), "tailed_triangle": (1, 2, 2, 3), "diamond": (2, 2, 3, 3), "clique4": (3, 3, 3, 3)}
    assert rows(spark, sf, "motif4_formula") == sorted((m, four[d]) for m, d in degrees.items())
    label = {v: v * 7 % 50 % 4 for v in vertices}
    ends, wedges = defaultdict(lambda: (set(), set())), defaultdict(lambda: (set(), set(), set()))
    for c in vertices:
        for a in near[c]:
            if label[c] <= label[a]:
                for at, v in enumerate((c, a)):
                    ends[label[c], label[a]][at].add(v)
            for b in near[c] - {a}:
                if label[a] <= label[b]:
                    for at, v in enumerate((c, a, b)):
                        wedges[label[c], label[a], label[b]][at].add(v)
    assert rows(spark, sf, "fsm_edge_patterns") == sorted((*k, min(map(len, x))) for k, x in ends.items())
    assert rows(spark, sf, "fsm_wedge_patterns") == sorted((*k, min(map(len, x))) for k, x in wedges.items())


def test_triangle_count(spark, sf):
    pairs = {(a, b) for _, parts in ORDERS for a, b in combinations(sorted(set(parts)), 2)}
    want = sum((a, c) in pairs for a, b in pairs for x, c in pairs if x == b)
    assert want and rows(spark, sf, "triangle_count_all_pairs") == [(want,)]
