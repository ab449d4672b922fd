"""Registered queries of the graph operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark import graph as G
from graphspark.functions import grids, rates, reductions
from graphspark.graph import Graph
from graphspark.operators import coloring, connectivity, factor, fsm, linalg, motifs, patterns, ranking, sets, spanning, traversal
from graphspark.plans import datasets as D
from graphspark.session import ensure_importable, materialize, scratch_path
from graphspark.sources import convert, generators, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Derived graphs as common table expressions.
SEQ = "seq AS MATERIALIZED (SELECT DISTINCT s src, d dst FROM (SELECT l_partkey s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) d FROM lineitem) WHERE d IS NOT NULL AND s <> d), vs AS MATERIALIZED (SELECT DISTINCT v FROM (SELECT src v FROM seq UNION ALL SELECT dst FROM seq))"
COP2 = "half AS MATERIALIZED (SELECT a.l_partkey u, b.l_partkey v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2), e AS MATERIALIZED (SELECT u, v FROM half UNION ALL SELECT v, u FROM half)"
COP = "half AS MATERIALIZED (SELECT DISTINCT a.l_partkey u, b.l_partkey v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), e AS MATERIALIZED (SELECT u, v FROM half UNION ALL SELECT v, u FROM half)"
DIRECTED = COP2 + ", dp AS MATERIALIZED (SELECT CASE WHEN (31 * u + 17 * v) % 2 = 0 THEN u ELSE v END src, CASE WHEN (31 * u + 17 * v) % 2 = 0 THEN v ELSE u END dst FROM half), n AS (SELECT src v FROM dp UNION SELECT dst FROM dp)"
RATINGS = "r AS MATERIALIZED (SELECT o_custkey u, l_suppkey i, avg(l_quantity) r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
LABELS = "lab AS (SELECT p_partkey v, CAST(p_size % 4 AS INTEGER) label FROM part)"


def query(oracle: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL for the same rows where there is any."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


SOURCE = 0


# Traversal

@query(f"WITH RECURSIVE {SEQ}, r(v, d) AS (SELECT CAST({SOURCE} AS BIGINT), 0 UNION SELECT seq.dst, r.d + 1 FROM r JOIN seq ON seq.src = r.v WHERE r.d < 12) SELECT v, min(d) AS depth FROM r GROUP BY v")
def bfs_levels(spark, sf):
    return traversal.bfs(D.seq_graph(spark, sf), SOURCE)


@query(f"WITH RECURSIVE {SEQ}, r(v, d) AS (SELECT CAST({SOURCE} AS BIGINT), 0 UNION SELECT seq.dst, r.d + 1 FROM r JOIN seq ON seq.src = r.v WHERE r.d < 12) SELECT depth, count(*) AS vertices FROM (SELECT v, min(d) AS depth FROM r GROUP BY v) GROUP BY depth")
def bfs_level_hist(spark, sf):
    return traversal.bfs(D.seq_graph(spark, sf), SOURCE, mode="auto").groupBy("depth").agg(F.count("*").alias("vertices"))


@query(f"WITH RECURSIVE {SEQ}, r(v, d) AS (SELECT min(src), 0 FROM seq UNION SELECT seq.dst, r.d + 1 FROM r JOIN seq ON seq.src = r.v WHERE r.d < 12) SELECT vs.v, min(r.d) AS depth FROM vs LEFT JOIN r ON vs.v = r.v GROUP BY vs.v")
def bfs_pull_all(spark, sf):
    g = D.seq_graph(spark, sf)
    return traversal.bfs_all(g, g.edges.agg(F.min("src")).first()[0], mode="pull")


_SSSP = "WITH RECURSIVE {SEQ}, w AS MATERIALIZED (SELECT src, dst, {W} w FROM seq), r AS (SELECT 0 it, CAST({S} AS BIGINT) v, CAST(0 AS BIGINT) d UNION ALL SELECT * FROM (SELECT it + 1, v, min(d) FROM (SELECT r.it, w.dst v, r.d + w.w d FROM r JOIN w ON w.src = r.v UNION ALL SELECT it, v, d FROM r) WHERE it < {N} GROUP BY it, v)) SELECT v, min(d) AS distance FROM r GROUP BY v"


@query(_SSSP.format(SEQ=SEQ, W="1 + (31 * src + 17 * dst) % 255", S=SOURCE, N=30))
def sssp_weighted(spark, sf):
    return traversal.sssp(D.weighted_seq_graph(spark, sf), SOURCE)


@query(_SSSP.format(SEQ=SEQ, W="1 + (31 * src + 17 * dst) % 255", S=SOURCE, N=30))
def sssp_delta(spark, sf):
    return traversal.sssp(D.weighted_seq_graph(spark, sf), SOURCE, delta=64)


@query(_SSSP.format(SEQ=SEQ, W="1", S=SOURCE, N=12))
def sssp_unit(spark, sf):
    return traversal.sssp(D.seq_graph(spark, sf), SOURCE, unit=True)


@query(
    f"""WITH RECURSIVE {SEQ}, lv AS MATERIALIZED (SELECT v, min(d) d FROM (
        WITH RECURSIVE q(v, d) AS (SELECT CAST({SOURCE} AS BIGINT), 0 UNION SELECT seq.dst, q.d + 1 FROM q JOIN seq ON seq.src = q.v WHERE q.d < 12) SELECT * FROM q) GROUP BY v),
        te AS MATERIALIZED (SELECT seq.src, seq.dst, a.d FROM seq JOIN lv a ON a.v = src JOIN lv b ON b.v = dst AND b.d = a.d + 1),
        top AS (SELECT max(d) m FROM lv),
        sg(it, v, s) AS (SELECT 0, CAST({SOURCE} AS BIGINT), CAST(1 AS DOUBLE) UNION ALL SELECT * FROM (SELECT sg.it + 1, te.dst, sum(sg.s) FROM sg JOIN te ON te.src = sg.v AND te.d = sg.it GROUP BY sg.it, te.dst)),
        dl(it, v, x) AS (SELECT top.m, lv.v, CAST(0 AS DOUBLE) FROM lv, top WHERE lv.d = top.m UNION ALL SELECT * FROM (
            SELECT dl.it - 1, te.src, sum(a.s / b.s * (1 + dl.x)) FROM dl JOIN te ON te.dst = dl.v AND te.d = dl.it - 1 JOIN sg a ON a.v = te.src JOIN sg b ON b.v = te.dst GROUP BY dl.it, te.src
            UNION ALL SELECT dl.it - 1, lv.v, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT it FROM dl) dl JOIN lv ON lv.d = dl.it - 1 WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.src = lv.v)))
        SELECT v, round(x / (SELECT max(x) FROM dl), 6) AS score FROM dl"""
)
def bc_single_source(spark, sf):
    return traversal.betweenness(D.seq_graph(spark, sf), SOURCE).where("depth is not null").select("v", F.round("score", 6).alias("score"))


# Ranking

def _pr_sql(rounds: int, out: str) -> str:
    return f"""WITH RECURSIVE {SEQ}, m AS (SELECT count(*) m FROM vs), od AS MATERIALIZED (SELECT src, count(*) k FROM seq GROUP BY src),
        r AS (SELECT 0 it, v, CAST(1 AS DOUBLE) / m s FROM vs, m UNION ALL SELECT * FROM (
            SELECT it + 1, v, 0.15 / (SELECT m FROM m) + 0.85 * sum(c) FROM (SELECT r.it, seq.dst v, r.s / od.k c FROM r JOIN seq ON seq.src = r.v JOIN od ON od.src = r.v UNION ALL SELECT it, v, 0 FROM r) WHERE it < {rounds} GROUP BY it, v))
        {out}"""


@query(_pr_sql(10, "SELECT v, round(s * (SELECT m FROM m), 5) AS score FROM r WHERE it = 10"))
def pagerank_fixed10(spark, sf):
    g = D.seq_graph(spark, sf)
    scores, _ = ranking.pagerank(g, tolerance=None, iterations=10, batch=5)
    return scores.select("v", F.round(F.col("score") * g.vertices.count(), 5).alias("score"))


@query(_pr_sql(60, "SELECT v, round(s * (SELECT m FROM m), 2) AS score FROM r WHERE it = 60"))
def pagerank_converged(spark, sf):
    g = D.seq_graph(spark, sf)
    scores, _ = ranking.pagerank(g, tolerance=1e-9)
    return scores.select("v", F.round(F.col("score") * g.vertices.count(), 2).alias("score"))


@query(_pr_sql(60, "SELECT v, round(s * (SELECT m FROM m), 3) AS score FROM r WHERE it = 60"))
def pagerank_delta(spark, sf):
    g = D.seq_graph(spark, sf)
    scores, _ = ranking.pagerank_delta(g, tolerance=1e-10)
    return scores.select("v", F.round(F.col("score") * g.vertices.count(), 3).alias("score"))


# Connectivity

_CC = f"WITH RECURSIVE {COP2}, r(v, l) AS (SELECT u, u FROM e UNION SELECT e.v, r.l FROM r JOIN e ON r.v = e.u WHERE r.l < e.v)"


@query(f"{_CC} SELECT v, min(l) AS component FROM r GROUP BY v")
def cc_labels(spark, sf):
    return connectivity.connected_components(D.cop2_graph(spark, sf))


@query(f"{_CC} SELECT v, min(l) AS component FROM r GROUP BY v")
def cc_afforest(spark, sf):
    return connectivity.afforest(D.cop2_graph(spark, sf))


@query(f"{_CC}, c AS (SELECT v, min(l) AS component FROM r GROUP BY v) SELECT component, count(*) AS vertices FROM c GROUP BY component")
def cc_sizes(spark, sf):
    return connectivity.connected_components(D.cop2_graph(spark, sf)).groupBy("component").agg(F.count("*").alias("vertices"))


# The component of one vertex by what it reaches and what reaches it, the rest by closure among themselves.
_SCC = f"""WITH RECURSIVE {SEQ}, f(v) AS (SELECT min(v) FROM vs UNION SELECT dst FROM f JOIN seq ON src = f.v), b(v) AS (SELECT min(v) FROM vs UNION SELECT src FROM b JOIN seq ON dst = b.v),
    giant AS MATERIALIZED (SELECT v FROM f INTERSECT SELECT v FROM b), re AS MATERIALIZED (SELECT src, dst FROM seq WHERE src NOT IN (SELECT v FROM giant) AND dst NOT IN (SELECT v FROM giant)),
    r(a, b) AS (SELECT v, v FROM vs WHERE v NOT IN (SELECT v FROM giant) UNION SELECT r.a, re.dst FROM r JOIN re ON re.src = r.b),
    c AS (SELECT v, (SELECT min(v) FROM giant) component FROM giant UNION ALL SELECT x.a, min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1)"""
_SIZES = "SELECT size, count(*) AS components FROM (SELECT component, count(*) AS size FROM c GROUP BY component) GROUP BY size"
_SCC_PAIRS = f"WITH RECURSIVE {DIRECTED}, r(a, b) AS (SELECT v, v FROM n UNION SELECT r.a, dp.dst FROM r JOIN dp ON dp.src = r.b), c AS (SELECT x.a v, min(x.b) component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1)"


@query(f"{_SCC} SELECT v, component FROM c")
def scc_labels(spark, sf):
    return connectivity.strongly_connected_components(D.seq_graph(spark, sf))


@query(f"{_SCC} {_SIZES}")
def scc_sizes(spark, sf):
    return writers.component_report(connectivity.strongly_connected_components(D.seq_graph(spark, sf)))


@query(f"{_SCC_PAIRS} SELECT v, component FROM c")
def scc_pairs_labels(spark, sf):
    """Many components: the rounds of the second phase."""
    return connectivity.strongly_connected_components(D.directed_pairs_graph(spark, sf))


@query(f"{_SCC_PAIRS} {_SIZES}")
def scc_pairs_sizes(spark, sf):
    return writers.component_report(connectivity.strongly_connected_components(D.directed_pairs_graph(spark, sf)))


#: Core numbers are the greatest values that are the h-index of their neighbours' values.
_CORES = f"""WITH RECURSIVE {COP2}, c(v, k) USING KEY (v) AS (SELECT u, count(*) FROM e GROUP BY u UNION SELECT * FROM (
    SELECT h.v, h.k FROM (SELECT v, max(least(x, place)) k FROM (SELECT e.u v, y.k x, row_number() OVER (PARTITION BY e.u ORDER BY y.k DESC) place FROM e JOIN recurring.c y ON y.v = e.v) GROUP BY v) h JOIN recurring.c o ON o.v = h.v WHERE h.k < o.k))
    SELECT v, CAST(k AS INTEGER) AS core FROM c"""


@query(_CORES)
def kcore(spark, sf):
    return connectivity.core_numbers(D.cop2_graph(spark, sf))


#: A forest of least weight has, for each weight w, as many edges over w as there are components of the edges of weight w or less, beyond those of all.
_MST = f"""WITH RECURSIVE {COP2}, we AS MATERIALIZED (SELECT u, v, 1 + (31 * least(u, v) + 17 * greatest(u, v)) % 255 w FROM e), vs AS MATERIALIZED (SELECT DISTINCT u v FROM e), t AS (SELECT unnest(range(0, 256)) t),
    r(t, v, l) USING KEY (t, v) AS (SELECT CAST(t.t AS BIGINT), vs.v, vs.v FROM t, vs UNION SELECT * FROM (
        SELECT r.t, we.v, min(r.l) FROM r JOIN we ON we.u = r.v AND we.w <= r.t JOIN recurring.r o ON o.t = r.t AND o.v = we.v WHERE r.l < o.l GROUP BY r.t, we.v)),
    k AS (SELECT t, count(DISTINCT l) k FROM r GROUP BY t)
    SELECT CAST(sum(k.k - z.k) AS BIGINT) AS weight, (SELECT count(*) FROM vs) - any_value(z.k) AS edges, any_value(z.k) AS components FROM k, (SELECT k FROM k WHERE t = 255) z"""


@query(_MST)
def mst_weight(spark, sf):
    g = D.cop2_graph(spark, sf)
    return spanning.forest_summary(Graph(g.edges.withColumn("weight", F.lit(1) + (F.lit(31) * F.least("src", "dst") + F.lit(17) * F.greatest("src", "dst")) % 255), g.vertices, False))


@query("SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored")
def vc_validity(spark, sf):
    g = D.cop2_graph(spark, sf)
    colors = coloring.color(g)
    return coloring.conflicts(g, colors).agg(F.count("*").alias("conflicts")).crossJoin(g.vertices.join(colors, "v", "left").where("color is null").agg(F.count("*").alias("uncolored")))


# Linear algebra and factorization

@query(f"WITH {SEQ} SELECT vs.v, round(0.06 * count(seq.src), 6) AS value FROM vs LEFT JOIN seq ON seq.dst = vs.v GROUP BY vs.v")
def spmv(spark, sf):
    g = D.seq_graph(spark, sf)
    return linalg.spmv(g, g.vertices.select("v", F.lit(0.3).alias("value")), weight=0.2).select("v", F.round("value", 6).alias("value"))


@query(f"WITH {SEQ} SELECT vs.v, CAST(coalesce(sum((1 + (31 * src + 17 * dst) % 255) * (1 + src % 7)), 0) AS DOUBLE) AS value FROM vs LEFT JOIN seq ON seq.dst = vs.v GROUP BY vs.v")
def spmv_weighted(spark, sf):
    g = D.weighted_seq_graph(spark, sf)
    return linalg.spmv(g, g.vertices.select("v", (1.0 + F.col("v") % 7).alias("value")))


def _symgs_sql(classes: int) -> str:
    steps, rounds = "x0 AS MATERIALIZED (SELECT v, CAST(0 AS DOUBLE) x FROM d)", [*range(classes), *reversed(range(classes))]
    for i, c in enumerate(rounds):
        steps += f", x{i + 1} AS MATERIALIZED (SELECT o.v, CASE WHEN o.v % {classes} = {c} THEN (1 + coalesce(s.s, 0)) / (2 * d.k + 1) ELSE o.x END x FROM x{i} o JOIN d ON d.v = o.v LEFT JOIN (SELECT e.u v, sum(y.x) s FROM e JOIN x{i} y ON y.v = e.v GROUP BY 1) s ON s.v = o.v)"
    return f"WITH {COP2}, d AS MATERIALIZED (SELECT u v, count(*) k FROM e GROUP BY u), {steps} SELECT v, round(x, 9) AS value FROM x{len(rounds)}"


@query(_symgs_sql(3))
def symgs_sweep(spark, sf):
    """A sweep up and down over three classes of rows (v modulo 3) of a diagonally dominant system; rows of a class move together."""
    g = D.cop2_graph(spark, sf)
    matrix = g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(-1.0).alias("value"))
    diagonal = G.out_degrees(g).select("v", (2.0 * F.col("degree") + 1.0).alias("value"))
    classes = g.vertices.select("v", (F.col("v") % 3).cast("int").alias("color"))
    x = linalg.symmetric_gauss_seidel(matrix, diagonal, g.vertices.select("v", F.lit(1.0).alias("value")), classes)
    return x.select("v", F.round("value", 9).alias("value"))


@query(f"WITH {RATINGS} SELECT round(sqrt(sum((r - 0.05) * (r - 0.05)) / count(*)), 6) AS rmse FROM r")
def sgd_rmse_epoch0(spark, sf):
    r = D.ratings(spark, sf)
    users, items = (factor.initial_latents(r.select(F.col(c).alias("id")).distinct(), value=0.05) for c in ("u", "i"))
    return factor.rmse(r, users, items).select(F.round("rmse", 6).alias("rmse"))


@query(
    f"""WITH {RATINGS}, gu AS (SELECT u, sum(0.0001 * (-0.001 * 0.05 + 0.05 * (r - 0.05))) g FROM r GROUP BY u), gi AS (SELECT i, sum(0.0001 * (-0.001 * 0.05 + 0.05 * (r - 0.05))) g FROM r GROUP BY i)
    SELECT round(sqrt(sum((r - 20 * (0.05 + gu.g) * (0.05 + gi.g)) * (r - 20 * (0.05 + gu.g) * (0.05 + gi.g))) / count(*)), 6) AS rmse FROM r JOIN gu USING (u) JOIN gi USING (i)"""
)
def sgd_batch_epoch(spark, sf):
    r = D.ratings(spark, sf)
    users, items = (factor.initial_latents(r.select(F.col(c).alias("id")).distinct(), value=0.05) for c in ("u", "i"))
    users, items, _ = factor.sgd_batch(r, users, items, eta=1e-4, iterations=1)
    return factor.rmse(r, users, items).select(F.round("rmse", 6).alias("rmse"))


@query()
def sgd_rows_epoch(spark, sf):
    """An epoch of updates in row order (user, item), which is one task by its nature; SQL has no such loop, a test in plain Python has."""
    r = D.ratings(spark, sf)
    users, items = (factor.initial_latents(r.select(F.col(c).alias("id")).distinct(), value=0.05) for c in ("u", "i"))
    out = factor.sgd_sequential(r, users, items, eta=1e-4, iterations=1)
    return out.groupBy("side").agg(F.count("*").alias("rows"), F.round(F.max(F.col("rmses")[0]), 6).alias("rmse"), F.round(F.sum(F.aggregate("latent", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


# Triangles, cliques, motifs

@query(f"WITH {COP2} SELECT count(*) AS total FROM half a JOIN half b ON a.v = b.u JOIN half x ON x.u = a.u AND x.v = b.v")
def triangle_count(spark, sf):
    return motifs.triangle_count(D.cop2_graph(spark, sf).edges)


_T3 = "t AS (SELECT a.u x, a.v y, b.v z FROM half a JOIN half b ON a.v = b.u JOIN half c ON c.u = a.u AND c.v = b.v)"


@query(f"WITH {COP}, {_T3} SELECT v, count(*) AS triangles FROM (SELECT x v FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY v")
def triangles_per_vertex(spark, sf):
    return motifs.triangles_per_vertex(D.cop_graph(spark, sf).edges)


@query(f"WITH {COP} SELECT count(*) AS total FROM half a JOIN half b ON a.v = b.u JOIN half x ON x.u = a.u AND x.v = b.v")
def triangle_count_all_pairs(spark, sf):
    return motifs.triangle_count(D.cop_graph(spark, sf).edges)


def _clique_sql(k: int, out: str, graph: str = COP) -> str:
    joins = "".join(f" JOIN half e{i} ON e{i}.u = e{i - 1}.v" + "".join(f" JOIN half c{j}_{i} ON c{j}_{i}.u = e{j + 1}.u AND c{j}_{i}.v = e{i}.v" for j in range(i - 1)) for i in range(2, k))
    return f"WITH {graph} SELECT {out} FROM half e1{joins}"


for _k in (3, 4, 5):
    def _cliques(spark, sf, k=_k):
        return motifs.clique_count(D.cop_graph(spark, sf).edges, k)

    _cliques.__name__ = f"clique{_k}_count"
    query(_clique_sql(_k, "count(*) AS total"))(_cliques)


@query(_clique_sql(4, "e1.u AS v0, e1.v AS v1, e2.v AS v2, e3.v AS v3"))
def clique4_list(spark, sf):
    c = motifs.cliques(D.cop_graph(spark, sf).edges, 4).select(F.array_sort(F.array("v0", "v1", "v2", "v3")).alias("c"))
    return c.select(*[F.col("c")[i].alias(f"v{i}") for i in range(4)])


_M3 = "SELECT 'triangle' AS motif, t AS total FROM tt UNION ALL SELECT 'wedge', w - 3 * t FROM tt, ww"
_T = "tt AS (SELECT count(*) t FROM half a JOIN half b ON a.v = b.u JOIN half x ON x.u = a.u AND x.v = b.v), ww AS (SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) w FROM (SELECT u, count(*) k FROM e GROUP BY u))"


@query(f"WITH {COP}, {_T} {_M3}")
def motif3(spark, sf):
    return motifs.motifs(D.cop_graph(spark, sf).edges, 3)


@query(f"WITH {COP}, {_T} {_M3}")
def motif3_formula(spark, sf):
    return motifs.motifs_by_formula(D.cop_graph(spark, sf).edges, 3)


def _motif_sql(graph: str) -> str:
    """Induced counts of 4-vertex motifs from non-induced ones, by the inclusion of patterns in each other."""
    return f"""WITH {graph}, d AS (SELECT u, count(*) k FROM e GROUP BY u),
        tri AS (SELECT a.u, a.v, count(c.u) t FROM half a LEFT JOIN e b ON b.u = a.v LEFT JOIN e c ON c.u = a.u AND c.v = b.v GROUP BY 1, 2),
        n AS (SELECT (SELECT CAST(coalesce(sum(t), 0) AS BIGINT) // 3 FROM tri) t3,
            (SELECT CAST(coalesce(sum(t * (t - 1) // 2), 0) AS BIGINT) FROM tri) dia,
            (SELECT count(*) FROM half a JOIN half b ON b.u = a.v JOIN half ab ON ab.u = a.u AND ab.v = b.v JOIN half c ON c.u = b.v JOIN half ac ON ac.u = a.u AND ac.v = c.v JOIN half bc ON bc.u = a.v AND bc.v = c.v) k4,
            (SELECT CAST(coalesce(sum(q * (q - 1) // 2) // 2, 0) AS BIGINT) FROM (SELECT count(*) q FROM e a JOIN e b ON a.u = b.u AND a.v < b.v GROUP BY a.v, b.v)) c4,
            (SELECT CAST(sum(k * (k - 1) * (k - 2) // 6) AS BIGINT) FROM d) star,
            (SELECT CAST(sum((x.k - 1) * (y.k - 1)) AS BIGINT) FROM half JOIN d x ON x.u = half.u JOIN d y ON y.u = half.v) p4raw,
            (SELECT CAST(coalesce(sum(t * (d.k - 2)), 0) AS BIGINT) // 2 FROM (SELECT u, sum(t) t FROM (SELECT u, t FROM tri UNION ALL SELECT v, t FROM tri) GROUP BY u) z JOIN d USING (u)) tail),
        i AS (SELECT k4, dia - 6 * k4 di, c4 - (dia - 6 * k4) - 3 * k4 ci, tail - 4 * (dia - 6 * k4) - 12 * k4 ta, star, p4raw - 3 * t3 p4 FROM n)
        SELECT 'clique4' AS motif, k4 AS total FROM i UNION ALL SELECT 'diamond', di FROM i UNION ALL SELECT 'rectangle', ci FROM i UNION ALL SELECT 'tailed_triangle', ta FROM i
        UNION ALL SELECT 'star3', star - ta - 2 * di - 4 * k4 FROM i UNION ALL SELECT 'path4', p4 - 2 * ta - 4 * ci - 6 * di - 12 * k4 FROM i"""


@query(_motif_sql(COP2))
def motif4(spark, sf):
    return motifs.motifs(D.cop2_graph(spark, sf).edges, 4)


@query(_motif_sql(COP))
def motif4_formula(spark, sf):
    return motifs.motifs_by_formula(D.cop_graph(spark, sf).edges, 4)


#: Connected sets grow by one neighbour at a time; a class is told by edges, sorted degrees and triangles.
_MOTIF5 = f"""WITH {COP2}, s2 AS (SELECT [u, v] s FROM half),
    s3 AS MATERIALIZED (SELECT DISTINCT list_sort(list_append(s, e.v)) s FROM (SELECT s, unnest(s) x FROM s2) JOIN e ON e.u = x WHERE NOT list_contains(s, e.v)),
    s4 AS MATERIALIZED (SELECT DISTINCT list_sort(list_append(s, e.v)) s FROM (SELECT s, unnest(s) x FROM s3) JOIN e ON e.u = x WHERE NOT list_contains(s, e.v)),
    s5 AS MATERIALIZED (SELECT row_number() OVER () i, s FROM (SELECT DISTINCT list_sort(list_append(s, e.v)) s FROM (SELECT s, unnest(s) x FROM s4) JOIN e ON e.u = x WHERE NOT list_contains(s, e.v))),
    m AS MATERIALIZED (SELECT i, unnest(s) v FROM s5), en AS MATERIALIZED (SELECT a.i, a.v a, b.v b FROM m a JOIN m b ON a.i = b.i JOIN e ON e.u = a.v AND e.v = b.v),
    d AS (SELECT i, list_sort(list(k)) ds, CAST(sum(k) AS BIGINT) // 2 es FROM (SELECT i, a, count(*) k FROM en GROUP BY i, a) GROUP BY i),
    tr AS (SELECT x.i, count(*) // 6 t FROM en x JOIN en y ON y.i = x.i AND y.a = x.b JOIN en z ON z.i = x.i AND z.a = y.b AND z.b = x.a GROUP BY x.i)
    SELECT concat(d.es, '; ', array_to_string(d.ds, ' '), '; ', coalesce(tr.t, 0)) AS motif, count(*) AS total FROM d LEFT JOIN tr USING (i) GROUP BY 1"""


@query(_MOTIF5)
def motif5(spark, sf):
    return motifs.motifs(D.cop2_graph(spark, sf).edges, 5)


# Subgraph listing, on the sparse graph: induced or not

_DISTINCT5 = "a.u <> c.v AND a.v <> b.v"
_SGL = {
    "diamond": ("SELECT CAST(coalesce(sum(t * (t - 1) // 2), 0) AS BIGINT) AS total FROM (SELECT a.u, a.v, count(*) t FROM half a JOIN e b ON b.u = a.u JOIN e c ON c.u = a.v AND c.v = b.v GROUP BY 1, 2)",
                "SELECT count(*) AS total FROM half x JOIN e a ON a.u = x.u JOIN e b ON b.u = x.v AND b.v = a.v JOIN e c ON c.u = x.u AND c.v > a.v JOIN e f ON f.u = x.v AND f.v = c.v WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.v AND g.v = c.v)"),
    "rectangle": ("SELECT CAST(coalesce(sum(q * (q - 1) // 2) // 2, 0) AS BIGINT) AS total FROM (SELECT count(*) q FROM e a JOIN e b ON a.u = b.u AND a.v < b.v GROUP BY a.v, b.v)",
                  "SELECT count(*) // 2 AS total FROM e a JOIN e b ON b.u = a.v AND b.v > a.u JOIN e c ON c.u = a.u AND c.v > a.v JOIN e d ON d.u = b.v AND d.v = c.v WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.u AND g.v = b.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.v AND g.v = c.v)"),
    "pentagon": ("SELECT count(*) // 10 AS total FROM e a JOIN e b ON b.u = a.v AND b.v <> a.u JOIN e c ON c.u = b.v AND c.v <> a.u AND c.v <> a.v JOIN e d ON d.u = c.v AND d.v <> a.u AND d.v <> a.v AND d.v <> b.v JOIN e f ON f.u = d.v AND f.v = a.u",
                 "SELECT count(*) // 10 AS total FROM e a JOIN e b ON b.u = a.v AND b.v <> a.u JOIN e c ON c.u = b.v AND c.v <> a.u AND c.v <> a.v JOIN e d ON d.u = c.v AND d.v <> a.u AND d.v <> a.v AND d.v <> b.v JOIN e f ON f.u = d.v AND f.v = a.u WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.u AND g.v = b.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.u AND g.v = c.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.v AND g.v = c.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = a.v AND g.v = d.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = b.v AND g.v = d.v)"),
    # square p q r s with roof t on p q
    "house": ("SELECT count(*) // 2 AS total FROM e pq JOIN e qr ON qr.u = pq.v AND qr.v <> pq.u JOIN e rs ON rs.u = qr.v AND rs.v <> pq.v AND rs.v <> pq.u JOIN e sp ON sp.u = rs.v AND sp.v = pq.u JOIN e pt ON pt.u = pq.u AND pt.v <> qr.v AND pt.v <> rs.v JOIN e qt ON qt.u = pq.v AND qt.v = pt.v",
              "SELECT count(*) // 2 AS total FROM e pq JOIN e qr ON qr.u = pq.v AND qr.v <> pq.u JOIN e rs ON rs.u = qr.v AND rs.v <> pq.v AND rs.v <> pq.u JOIN e sp ON sp.u = rs.v AND sp.v = pq.u JOIN e pt ON pt.u = pq.u AND pt.v <> qr.v AND pt.v <> rs.v JOIN e qt ON qt.u = pq.v AND qt.v = pt.v WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.u = pq.u AND g.v = qr.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = pq.v AND g.v = rs.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = pt.v AND g.v = qr.v) AND NOT EXISTS (SELECT 1 FROM e g WHERE g.u = pt.v AND g.v = rs.v)"),
}

for _name, _sql in _SGL.items():
    for _induced in (False, True):
        def _listing(spark, sf, name=_name, induced=_induced):
            edges = D.cop2_graph(spark, sf).edges
            if not induced and name in ("diamond", "rectangle"):
                return {"diamond": patterns.diamond_count, "rectangle": patterns.rectangle_count}[name](edges)
            return patterns.count_pattern(edges, name, induced)

        _listing.__name__ = f"sgl_{_name}" + "_induced" * _induced
        query(f"WITH {COP2} {_sql[_induced]}")(_listing)


# Frequent subgraphs

@query(f"WITH {COP}, {LABELS} SELECT x.label AS la, y.label AS lb, least(count(DISTINCT e.u), count(DISTINCT e.v)) AS support FROM e JOIN lab x ON x.v = e.u JOIN lab y ON y.v = e.v WHERE x.label <= y.label GROUP BY 1, 2")
def fsm_edge_patterns(spark, sf):
    return fsm.edge_pattern_support(D.cop_graph(spark, sf).edges, D.part_labels(spark, sf))


@query(f"WITH {COP}, {LABELS} SELECT z.label AS lc, x.label AS la, y.label AS lb, least(count(DISTINCT a.u), count(DISTINCT a.v), count(DISTINCT b.v)) AS support FROM e a JOIN e b ON a.u = b.u AND a.v <> b.v JOIN lab z ON z.v = a.u JOIN lab x ON x.v = a.v JOIN lab y ON y.v = b.v WHERE x.label <= y.label GROUP BY 1, 2, 3")
def fsm_wedge_patterns(spark, sf):
    return fsm.wedge_pattern_support(D.cop_graph(spark, sf).edges, D.part_labels(spark, sf), both_ways=True)


def _fsm_sql(graph: str, support: int, e: str = "e", label: str = "0") -> str:
    """Single edges and wedges by their canonical codes: sorted labels, and the least places of the edges over them."""
    return f"""WITH {graph}, {LABELS}, one AS (SELECT x.label la, y.label lb, least(count(DISTINCT e.u), count(DISTINCT e.v)) support FROM e JOIN lab x ON x.v = e.u JOIN lab y ON y.v = e.v WHERE x.label <= y.label GROUP BY 1, 2),
        two AS (SELECT z.label lc, x.label la, y.label lb, least(count(DISTINCT a.u), count(DISTINCT a.v), count(DISTINCT b.v)) support FROM e a JOIN e b ON a.u = b.u AND a.v <> b.v JOIN lab z ON z.v = a.u JOIN lab x ON x.v = a.v JOIN lab y ON y.v = b.v WHERE x.label <= y.label GROUP BY 1, 2, 3)
        SELECT CAST(1 AS INTEGER) AS edges, concat(la, ',', lb, '|0-1:0') AS code, support FROM one WHERE support >= {support}
        UNION ALL SELECT 2, concat(array_to_string(list_sort([la, lb, lc]), ','), '|', CASE CAST(la < lc AS INTEGER) + CAST(lb < lc AS INTEGER) WHEN 0 THEN '0-1:0 0-2:0' WHEN 1 THEN '0-1:0 1-2:0' ELSE '0-2:0 1-2:0' END), support FROM two WHERE support >= {support}"""


@query(f"WITH {COP2}, {LABELS}, le AS MATERIALIZED (SELECT e.u, e.v, (31 * least(e.u, e.v) + 17 * greatest(e.u, e.v)) % 3 l FROM e) SELECT concat(x.label, ',', y.label, '|0-1:', le.l) AS code, least(count(DISTINCT le.u), count(DISTINCT le.v)) AS support FROM le JOIN lab x ON x.v = le.u JOIN lab y ON y.v = le.v WHERE x.label <= y.label GROUP BY x.label, y.label, le.l HAVING least(count(DISTINCT le.u), count(DISTINCT le.v)) >= 20")
def fsm_edge_labels(spark, sf):
    """Single edges with labels of their own."""
    g = D.cop2_graph(spark, sf)
    labelled = g.edges.withColumn("elabel", ((F.lit(31) * F.least("src", "dst") + F.lit(17) * F.greatest("src", "dst")) % 3).cast("int"))
    return fsm.frequent_subgraphs(labelled, D.part_labels(spark, sf), 1, 20).select("code", "support")


@query(_fsm_sql(COP2, 20))
def fsm_k(spark, sf):
    """Patterns of up to two edges."""
    return fsm.frequent_subgraphs(D.cop2_graph(spark, sf).edges, D.part_labels(spark, sf), 2, 20)


# The graph model, sources and set algebra

@query(f"WITH {SEQ} SELECT vs.v, (SELECT count(*) FROM seq WHERE src = vs.v) AS outdegree, (SELECT count(*) FROM seq WHERE dst = vs.v) AS indegree FROM vs")
def degrees(spark, sf):
    g = D.seq_graph(spark, sf)
    return G.out_degrees(g).withColumnRenamed("degree", "outdegree").join(G.in_degrees(g).withColumnRenamed("degree", "indegree"), "v")


@query(f"WITH {COP2}, d AS (SELECT u, count(*) k FROM e GROUP BY u) SELECT e.u AS src, e.v AS dst FROM e JOIN d a ON a.u = e.u JOIN d b ON b.u = e.v WHERE b.k > a.k OR (b.k = a.k AND e.v > e.u)")
def orientation(spark, sf):
    return G.orient(D.cop2_graph(spark, sf).edges)


@query(f"WITH {COP2}, d AS (SELECT u, count(*) k FROM e GROUP BY u), r AS (SELECT u, row_number() OVER (ORDER BY k DESC, u DESC) - 1 AS i FROM d) SELECT a.i AS src, b.i AS dst FROM e JOIN r a ON a.u = e.u JOIN r b ON b.u = e.v")
def relabel_by_degree(spark, sf):
    return G.relabel_by_degree(D.cop2_graph(spark, sf))[0].edges


@query(f"WITH {COP2}, {LABELS} SELECT e.u AS v, lab.label, count(*) AS n FROM e JOIN lab ON lab.v = e.v GROUP BY 1, 2")
def neighbor_labels(spark, sf):
    g = D.cop2_graph(spark, sf)
    own = Graph(g.edges, D.part_labels(spark, sf), False)
    return G.neighbor_label_frequency(own).select("v", F.explode("frequencies").alias("label", "n")).select("v", "label", F.col("n").cast("long").alias("n"))


@query("SELECT CAST(p_size % 4 AS INTEGER) AS label, count(*) AS frequency FROM part GROUP BY 1")
def label_frequency(spark, sf):
    return G.label_frequency(Graph(D.seq_edges(spark, sf), D.part_labels(spark, sf)))


@query(f"WITH {COP2} SELECT half.u AS a, half.v AS b, (SELECT count(*) FROM e x JOIN e y ON x.v = y.v WHERE x.u = half.u AND y.u = half.v) AS both, (SELECT count(*) FROM e x WHERE x.u = half.u AND x.v <> half.v AND NOT EXISTS (SELECT 1 FROM e y WHERE y.u = half.v AND y.v = x.v)) AS only FROM half")
def set_algebra(spark, sf):
    """Numbers of common and of unshared neighbours of the ends of each edge, by joins: no array of neighbours is carried about."""
    edges = D.cop2_graph(spark, sf).edges
    pairs = G.half_edges(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = sets.neighbors_in_common(pairs, edges).groupBy("a", "b").agg(F.count("*").alias("both"))
    only = sets.neighbors_not_shared(pairs, edges).groupBy("a", "b").agg(F.count("*").alias("only"))
    return pairs.join(both, ["a", "b"], "left").join(only, ["a", "b"], "left").select("a", "b", F.coalesce("both", F.lit(0)).cast("long").alias("both"), F.coalesce("only", F.lit(0)).cast("long").alias("only"))


@query(f"WITH {COP2} SELECT half.u AS a, half.v AS b, (SELECT count(*) FROM e x JOIN e y ON x.v = y.v WHERE x.u = half.u AND y.u = half.v AND x.v < half.u) AS below, (SELECT count(*) FROM e x WHERE x.u = half.u AND x.v < half.v AND x.v <> half.v AND NOT EXISTS (SELECT 1 FROM e y WHERE y.u = half.v AND y.v = x.v)) AS only_below, (SELECT count(*) FROM (SELECT v FROM e x WHERE x.u = half.u UNION SELECT v FROM e y WHERE y.u = half.v)) AS either FROM half")
def set_algebra_bounded(spark, sf):
    """The bounded forms and the union, by arrays of one row."""
    edges = D.cop2_graph(spark, sf).edges
    near = G.adjacency(edges)
    pairs = G.half_edges(edges).join(near.select("src", F.col("neighbors").alias("na")), "src").join(near.select(F.col("src").alias("dst"), F.col("neighbors").alias("nb")), "dst")
    return pairs.select(
        F.col("src").alias("a"), F.col("dst").alias("b"), sets.intersection_count("na", "nb", F.col("src")).cast("long").alias("below"), sets.difference_count("na", "nb", F.col("dst"), F.col("dst")).cast("long").alias("only_below"), F.size(sets.union("na", "nb")).cast("long").alias("either")
    )


@query(f"WITH {COP2}, {LABELS} SELECT half.u AS a, half.v AS b, count(*) AS n FROM half JOIN e x ON x.u = half.u JOIN e y ON y.u = half.v AND y.v = x.v JOIN lab ON lab.v = x.v AND lab.label = 1 GROUP BY 1, 2")
def labelled_common(spark, sf):
    edges = D.cop2_graph(spark, sf).edges
    return sets.labelled_common_count(G.half_edges(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")), edges, D.part_labels(spark, sf), 1)


@query(f"WITH {COP2} SELECT half.u AS a, half.v AS b, x.v FROM half JOIN e x ON x.u = half.u JOIN e y ON y.u = half.v AND y.v = x.v")
def common_neighbors(spark, sf):
    edges = D.cop2_graph(spark, sf).edges
    return sets.neighbors_in_common(G.half_edges(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")), edges)


@query("SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders")
def prefix_sum(spark, sf):
    return writers.exclusive_prefix_sum(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "before")


@query()
def generated_rmat(spark, sf):
    """Out-degree histogram of a generated graph with about as many vertices as there are parts (the same on every run)."""
    scale = max(1, D.table(spark, sf, "part").count().bit_length())
    return G.out_degrees(generators.generate(spark, scale, 8)).groupBy("degree").agg(F.count("*").alias("vertices"))


@query("SELECT CAST(count(*) AS BIGINT) * 8 AS edges, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS badly_weighted FROM (SELECT unnest(range(0, CAST(pow(2, CAST(floor(log2(count(*))) AS INTEGER) + 1) AS BIGINT))) FROM part)")
def generated_uniform(spark, sf):
    """Edges, those with an end outside the vertices, and weights outside 1..255, of a uniform graph of that size."""
    scale = max(1, D.table(spark, sf, "part").count().bit_length())
    e = generators.random_weights(generators.uniform_edges(spark, scale, 8))
    outside = (F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= 1 << scale) | (F.col("dst") >= 1 << scale)
    return e.agg(F.count("*").alias("edges"), F.count_if(outside).alias("outside"), F.count_if((F.col("weight") < 1) | (F.col("weight") > 255)).alias("badly_weighted"))


# Files: tables written in a format and read back

def _written(spark: SparkSession, write, read) -> DataFrame:
    path = scratch_path(spark, "file")
    write(path)
    return read(path)


@query(f"WITH {SEQ} SELECT src, dst FROM seq")
def file_mtx(spark, sf):
    g = D.seq_graph(spark, sf)
    return _written(spark, lambda p: writers.write_mtx(g, p), lambda p: readers.read_mtx(spark, p, strict=True)).edges


@query(f"WITH {SEQ} SELECT src, dst, CAST(1 + (31 * src + 17 * dst) % 255 AS DOUBLE) AS weight FROM seq")
def file_mtx_weighted(spark, sf):
    g = D.weighted_seq_graph(spark, sf)
    return _written(spark, lambda p: writers.write_mtx(g, p), lambda p: readers.read_mtx(spark, p)).edges


@query(f"WITH {RATINGS} SELECT u, i, r FROM r")
def file_ratings(spark, sf):
    """A rectangular matrix of ratings."""
    r = materialize(D.ratings(spark, sf), "ratings")
    size = r.agg(F.max("u"), F.max("i"), F.count("*")).first()
    lines = r.select(F.concat_ws(" ", (F.col("u") + 1).cast("string"), (F.col("i") + 1).cast("string"), F.col("r").cast("string")).alias("value"))
    head = f"%%MatrixMarket matrix coordinate real general\n{size[0] + 1} {size[1] + 1} {size[2]}"
    return _written(spark, lambda p: writers.write_lines(lines, p, head), lambda p: readers.read_ratings_mtx(spark, p))


@query(f"WITH {SEQ} SELECT src, dst FROM seq")
def file_el(spark, sf):
    g = D.seq_graph(spark, sf)
    return _written(spark, lambda p: writers.write_el(g, p, base=1, header=True), lambda p: readers.read_el(spark, p, header=True, base=1)).edges


@query(f"WITH {SEQ} SELECT src, dst, CAST(1 + (31 * src + 17 * dst) % 255 AS DOUBLE) AS weight FROM seq")
def file_wel(spark, sf):
    g = D.weighted_seq_graph(spark, sf)
    return _written(spark, lambda p: writers.write_el(g, p), lambda p: readers.load_graph(spark, p, "wel")).edges


@query(f"WITH {SEQ} SELECT src, dst, 1 + (31 * src + 17 * dst) % 255 AS weight FROM seq")
def file_gr(spark, sf):
    g = D.weighted_seq_graph(spark, sf)
    return _written(spark, lambda p: writers.write_gr(g, p), lambda p: readers.load_graph(spark, p, "gr")).edges


@query(f"WITH {COP2} SELECT u AS src, v AS dst FROM e")
def file_metis(spark, sf):
    g = D.cop2_graph(spark, sf)
    return _written(spark, lambda p: writers.write_metis(g, p), lambda p: readers.load_graph(spark, p, "graph")).edges


@query(f"WITH {COP2} SELECT u AS src, v AS dst FROM e")
def file_adjacency(spark, sf):
    g = D.cop2_graph(spark, sf)
    return _written(spark, lambda p: writers.write_adjacency(g, p), lambda p: readers.load_graph(spark, p, "adj")).edges


@query(f"WITH {COP2}, {LABELS} SELECT e.u AS src, e.v AS dst, a.label AS la, b.label AS lb, CAST((31 * least(u, e.v) + 17 * greatest(u, e.v)) % 3 AS INTEGER) AS elabel FROM e JOIN lab a ON a.v = e.u JOIN lab b ON b.v = e.v")
def file_labelled(spark, sf):
    """Labels of vertices and of edges."""
    g = D.cop2_graph(spark, sf)
    own = Graph(g.edges.withColumn("elabel", ((F.lit(31) * F.least("src", "dst") + F.lit(17) * F.greatest("src", "dst")) % 3).cast("int")), D.part_labels(spark, sf), False)
    back = _written(spark, lambda p: writers.write_labelled(own, p), lambda p: readers.load_graph(spark, p, "lg"))
    a, b = back.vertices.select(F.col("v").alias("src"), F.col("label").alias("la")), back.vertices.select(F.col("v").alias("dst"), F.col("label").alias("lb"))
    return back.edges.join(a, "src").join(b, "dst").select("src", "dst", "la", "lb", "elabel")


@query(f"WITH {SEQ} SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM seq GROUP BY 1, 2")
def convert_cel(spark, sf):
    """From a matrix file to an edge list of each edge once."""
    g = D.seq_graph(spark, sf)
    source = scratch_path(spark, "file")
    writers.write_mtx(g, source)
    return _written(spark, lambda p: convert.convert(spark, source, p, "mtx", "cel"), lambda p: readers.load_graph(spark, p, "el")).edges


@query(f"WITH {SEQ} SELECT src, dst FROM seq UNION SELECT dst, src FROM seq")
def convert_sel(spark, sf):
    """From an edge list to one of both directions."""
    g = D.seq_graph(spark, sf)
    source = scratch_path(spark, "file")
    writers.write_el(g, source)
    return _written(spark, lambda p: convert.convert(spark, source, p, "el", "sel"), lambda p: readers.load_graph(spark, p, "el")).edges


@query(f"WITH {SEQ} SELECT src AS v, count(*) AS degree FROM seq GROUP BY src")
def file_degrees(spark, sf):
    """The dump of out-degrees, of those that aren't 0."""
    g = D.seq_graph(spark, sf)
    back = _written(spark, lambda p: writers.write_degrees(g, p), lambda p: spark.read.text(f"{p}/out_degree"))
    return back.select(F.split("value", " ")[0].cast("long").alias("v"), F.split("value", " ")[1].cast("long").alias("degree")).where("degree > 0")


# Set operations, vectors, matrices and grids

@query("""WITH s AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_partkey))) AS p FROM lineitem GROUP BY l_orderkey),
n AS (SELECT o_orderkey AS o, p, lead(p) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, (o_orderkey * 7) % 1000 AS k FROM orders JOIN s ON s.o = o_orderkey),
i AS (SELECT *, list_filter(p, lambda x: list_contains(q, x)) AS shared, list_filter(p, lambda x: NOT list_contains(q, x)) AS own FROM n WHERE q IS NOT NULL)
SELECT o, CAST(len(list_filter(shared, lambda x: x < k)) AS BIGINT) AS common_below, CAST(len(list_filter(shared, lambda x: x <> p[1])) AS BIGINT) AS common_without, CAST(list_sum(list_distinct(list_concat(p, q))) AS BIGINT) AS sum_union,
CAST(len(list_filter(own, lambda x: x <> p[1])) AS BIGINT) AS own_without, CAST(len(list_filter(own, lambda x: x < k)) AS BIGINT) AS own_below, CAST(len(list_filter(p, lambda x: x < k)) AS BIGINT) AS prefix, list_contains(q, p[1]) AS holds FROM i""")
def order_sets(spark, sf):
    """The array forms of the set operations, on the parts of an order and of its customer's next one."""
    parts = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_set("l_partkey")).alias("p"))
    orders = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), "o_custkey", ((F.col("o_orderkey") * 7) % 1000).alias("k"))
    pairs = orders.join(parts, "o").withColumn("q", F.lead("p").over(Window.partitionBy("o_custkey").orderBy("o"))).where("q is not null")
    p, q, k, least = F.col("p"), F.col("q"), F.col("k"), F.element_at("p", 1)
    return pairs.select(
        "o",
        sets.intersection_count(p, q, below=k).cast("long").alias("common_below"),
        sets.intersection_count(p, q, without=[least]).cast("long").alias("common_without"),
        F.aggregate(sets.union(p, q), F.lit(0).cast("long"), lambda total, x: total + x).alias("sum_union"),
        sets.difference_count(p, q, also=least).cast("long").alias("own_without"),
        sets.difference_count(p, q, below=k).cast("long").alias("own_below"),
        F.size(sets.bounded(p, k)).cast("long").alias("prefix"),
        sets.contains(q, least).alias("holds"),
    )


@query(f"WITH {COP2}, {LABELS} SELECT a.u AS a, a.v AS b, count(*) AS n FROM half a JOIN e x ON x.u = a.u JOIN e y ON y.u = a.v AND y.v = x.v JOIN lab ON lab.v = x.v AND lab.label = 1 GROUP BY 1, 2")
def common_labelled(spark, sf):
    """Common neighbours of label 1 of each pair."""
    g = D.cop2_graph(spark, sf)
    pairs = g.edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return sets.labelled_common_count(pairs, g.edges, D.part_labels(spark, sf), 1)


@query("SELECT p_partkey AS v, p_size + p_retailprice AS added, p_size * p_retailprice AS multiplied, 2.5 * p_size + p_retailprice AS saxpy FROM part")
def vector_arithmetic(spark, sf):
    part = D.table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return part.select(F.col("p_partkey").alias("v"), reductions.vec_add("p_size", "p_retailprice").alias("added"), reductions.vec_mul("p_size", "p_retailprice").alias("multiplied"), reductions.saxpy(2.5, "p_size", "p_retailprice").alias("saxpy"))


@query(f"WITH {SEQ} SELECT a.src AS row, b.dst AS col, CAST(count(*) AS DOUBLE) AS value FROM seq a JOIN seq b ON a.dst = b.src GROUP BY 1, 2")
def matrix_product(spark, sf):
    """The square of the adjacency matrix: paths of two edges."""
    m = D.seq_graph(spark, sf).edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("value"))
    return reductions.matmul(m, m)


#: Columns of the grid that the parts' keys are laid out on.
GRID_COLS = 40
_GRID = f"g0 AS (SELECT p_partkey // {GRID_COLS} AS row, p_partkey % {GRID_COLS} AS col, 300.0 + p_size AS temp, p_retailprice / 1000000 AS power FROM part)"
_AROUND = "LEFT JOIN {g} n ON n.row = g.row - 1 AND n.col = g.col LEFT JOIN {g} s ON s.row = g.row + 1 AND s.col = g.col LEFT JOIN {g} w ON w.row = g.row AND w.col = g.col - 1 LEFT JOIN {g} e ON e.row = g.row AND e.col = g.col + 1"


def _part_grid(spark, sf):
    key = F.col("p_partkey")
    return D.table(spark, sf, "part").select(F.floor(key / GRID_COLS).alias("row"), (key % GRID_COLS).alias("col"), (F.lit(300.0) + F.col("p_size")).alias("temp"), (F.col("p_retailprice") / 1000000).alias("power"))


@query(f"WITH {_GRID} SELECT g.row, g.col, round(CASE WHEN n.row IS NULL OR s.row IS NULL OR w.row IS NULL OR e.row IS NULL THEN g.temp ELSE (n.temp + s.temp + w.temp + e.temp) / 4 END, 6) AS value FROM g0 g {_AROUND.format(g='g0')}")
def laplace_smooth(spark, sf):
    return reductions.laplace_step(_part_grid(spark, sf).select("row", "col", F.col("temp").alias("value"))).select("row", "col", F.round("value", 6).alias("value"))


#: A grid of 50 by 40 cells on the chip.
_CHIP = grids.chip_constants(50, GRID_COLS)
_HEAT = "SELECT g.row, g.col, g.temp + {c[0]!r} * (g.power + (coalesce(n.temp, g.temp) + coalesce(s.temp, g.temp) - 2 * g.temp) / {c[2]!r} + (coalesce(w.temp, g.temp) + coalesce(e.temp, g.temp) - 2 * g.temp) / {c[1]!r} + (80.0 - g.temp) / {c[3]!r}) AS temp, g.power FROM {g} g {around}"


@query(f"WITH {_GRID}, g1 AS MATERIALIZED ({_HEAT.format(c=_CHIP, g='g0', around=_AROUND.format(g='g0'))}), g2 AS ({_HEAT.format(c=_CHIP, g='g1', around=_AROUND.format(g='g1'))}) SELECT row, col, round(temp, 5) AS temp FROM g2")
def hotspot_heat(spark, sf):
    grid = _part_grid(spark, sf)
    for _ in range(2):
        grid = grids.hotspot_step(grid, *_CHIP)
    return grid.select("row", "col", F.round("temp", 5).alias("temp"))


@query("""WITH l AS (SELECT l_orderkey o, l_linenumber i, min(l_partkey) p FROM lineitem GROUP BY 1, 2),
a AS MATERIALIZED (SELECT x.o, x.i, y.i j, 1 v FROM l x JOIN l y ON x.o = y.o AND x.i <> y.i AND (x.p + y.p) % 3 <> 0),
m2 AS MATERIALIZED (SELECT x.o, x.i, y.j, sum(x.v * y.v) v FROM a x JOIN a y ON x.o = y.o AND x.j = y.i GROUP BY 1, 2, 3),
m3 AS MATERIALIZED (SELECT x.o, x.i, y.j, sum(x.v * y.v) v FROM m2 x JOIN a y ON x.o = y.o AND x.j = y.i GROUP BY 1, 2, 3),
m4 AS (SELECT x.o, x.i, y.j, sum(x.v * y.v) v FROM m3 x JOIN a y ON x.o = y.o AND x.j = y.i GROUP BY 1, 2, 3),
t AS (SELECT o, 2 k, sum(v) p FROM m2 WHERE i = j GROUP BY o UNION ALL SELECT o, 3, sum(v) FROM m3 WHERE i = j GROUP BY o
 UNION ALL SELECT o, 4, sum(v * v) FROM m2 GROUP BY o UNION ALL SELECT x.o, 5, sum(x.v * y.v) FROM m2 x JOIN m3 y ON x.o = y.o AND x.i = y.i AND x.j = y.j GROUP BY x.o
 UNION ALL SELECT o, 6, sum(v * v) FROM m3 GROUP BY o UNION ALL SELECT x.o, 7, sum(x.v * y.v) FROM m3 x JOIN m4 y ON x.o = y.o AND x.i = y.i AND x.j = y.j GROUP BY x.o),
s AS (SELECT u.o, coalesce(sum(p) FILTER (k = 2), 0) p2, coalesce(sum(p) FILTER (k = 3), 0) p3, coalesce(sum(p) FILTER (k = 4), 0) p4, coalesce(sum(p) FILTER (k = 5), 0) p5, coalesce(sum(p) FILTER (k = 6), 0) p6, coalesce(sum(p) FILTER (k = 7), 0) p7
 FROM (SELECT DISTINCT o FROM l) u LEFT JOIN t ON t.o = u.o GROUP BY u.o),
c AS (SELECT *, -p2 / 2 c5, -p3 / 3 c4 FROM s), d AS (SELECT *, -(p4 + c5 * p2) / 4 c3, -(p5 + c5 * p3 + c4 * p2) / 5 c2 FROM c),
f AS (SELECT *, -(p6 + c5 * p4 + c4 * p3 + c3 * p2) / 6 c1, -(p7 + c5 * p5 + c4 * p4 + c3 * p3 + c2 * p2) / 7 c0 FROM d)
SELECT CAST(round(c0) AS BIGINT) c0, CAST(round(c1) AS BIGINT) c1, CAST(round(c2) AS BIGINT) c2, CAST(round(c3) AS BIGINT) c3, CAST(round(c4) AS BIGINT) c4, CAST(round(c5) AS BIGINT) c5, count(*) AS orders FROM f GROUP BY 1, 2, 3, 4, 5, 6""")
def characteristic_polynomials(spark, sf):
    """Orders by the characteristic polynomial of the graph of their line numbers (at most 7), linked where the keys of their
    least parts have a sum that 3 doesn't divide."""
    lines = D.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    orders = lines.groupBy("l_orderkey").agg(*(F.min(F.when(F.col("l_linenumber") == i, F.col("p"))).alias(f"p{i}") for i in range(1, 8)))
    cells = [F.coalesce(((F.col(f"p{i}") + F.col(f"p{j}")) % 3 != 0).cast("long"), F.lit(0).cast("long")) if i != j else F.lit(0).cast("long") for i in range(1, 8) for j in range(1, 8)]
    found = grids.characteristic_polynomial(orders.select(F.array(*cells).alias("m")).groupBy("m").agg(F.count("*").alias("n")), "m", 7)
    return found.groupBy(*(f"c{k}" for k in range(6))).agg(F.sum("n").alias("orders"))


@query()
def libor_swaptions(spark, sf):
    """A path of rates for each customer, with draws by rule."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(rates.UNTIL - 1)), lambda n: ((F.col("c_custkey") * 31 + n * 17) % 200 - 100) / 100.0)
    return rates.swaption_values(D.table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), draws.alias("z")))
