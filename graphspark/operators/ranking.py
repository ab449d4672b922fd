"""PageRank: pull, and by residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.graph import Graph
from graphspark.operators.vectors import Pushing
from graphspark.session import dealt, loop_materialize


def _contributions(g: Graph) -> DataFrame:
    """Edges with the share 1 / outdegree that the source sends along each."""
    deg = g.edges.groupBy("src").agg((1 / F.count("*")).alias("share"))
    return g.edges.select("src", "dst").join(deg, "src")


def pagerank(g: Graph, damping: float = 0.85, tolerance: float | None = 1e-4, iterations: int = 100, batch: int = 1) -> tuple[DataFrame, list[float]]:
    """((v, score), L1 errors by iteration); Jacobi steps, no redistribution of the mass of vertices without out-edges.

    ``tolerance=None`` runs exactly ``iterations`` steps; then ``batch`` of them make one job.
    """
    n = g.vertices.count()
    base = (1 - damping) / n if n else 0.0
    if tolerance is None:
        edges = dealt(_contributions(g), "src", tag="pr-edges")
        paths: list[str] = []
        scores = loop_materialize(g.vertices.select("v", F.lit(1.0 / n).alias("score")), "pr", paths)
        for step in range(iterations):
            into = edges.join(scores, edges["src"] == scores["v"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("s"))
            scores = scores.join(into, scores["v"] == into["dst"], "left").select("v", (F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("score"))
            if (step + 1) % batch == 0 or step + 1 == iterations:
                scores = loop_materialize(scores, "pr", paths)
        return scores, []

    def update(score, _, into):
        new = base + damping * into
        return new, _, float(np.abs(new - score).sum())

    pushing = Pushing(g, "pr", lambda k: (np.full(k, 1.0 / n), np.zeros(0)), lambda score, _: score)
    errors: list[float] = []
    for _ in range(iterations):
        errors.append(pushing.step(update, F.sum))
        if errors[-1] < tolerance:
            break
    return pushing.values(), errors


def pagerank_delta(g: Graph, damping: float = 0.85, tolerance: float = 1e-3, iterations: int = 100) -> tuple[DataFrame, int]:
    """((v, score), iterations): only vertices whose residual exceeds ``tolerance`` times their score send it on."""
    n = g.vertices.count()
    base = (1 - damping) / n if n else 0.0

    def update(first: bool):
        def run(score, delta, into):
            delta = damping * into + (base - 1.0 / n if first else 0.0)
            score = score + delta + (1.0 / n if first else 0.0)
            return score, delta, float(np.count_nonzero(np.abs(delta) > tolerance * score))

        return run

    # the first round sends from every vertex: its score is still 0
    pushing = Pushing(g, "pr-delta", lambda k: (np.zeros(k), np.full(k, 1.0 / n)), lambda score, delta: np.where(np.abs(delta) > tolerance * score, delta, 0.0))
    for step in range(iterations):
        if not pushing.step(update(step == 0), F.max):
            break
    return pushing.values(), step + 1


def pagerank_residual(g: Graph, scores: DataFrame, damping: float = 0.85) -> float:
    """L1 distance between scores and one more step from them."""
    n = g.vertices.count()
    into = _contributions(g).join(scores, F.col("src") == F.col("v")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("s"))
    new = scores.join(into, scores["v"] == into["dst"], "left")
    return new.agg(F.sum(F.abs((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0)) - F.col("score")))).first()[0] or 0.0
