"""Bounded training samples and small numpy optimisation helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of one text that a training sample holds by default, and the spans that a longer text gives them in.
SAMPLE_CHARS, SPANS = 20_000, 16


#: Hashes that decide on samples are taken modulo this.
DRAWS = 1 << 40


def drawing_bound(k: int, n: int) -> int:
    """Of ``n`` rows, those whose hash modulo DRAWS is below this are more than ``k`` but for chances not worth mentioning,
    and not many more; the ``k`` of least hash are then taken among them."""
    return min(DRAWS, int(DRAWS * (1.5 * k + 40) / n))


def spans_of(text: str, chars: int) -> Column:
    """A text of up to ``chars`` characters as it is; of a longer one SPANS spans of equal length, evenly spread from its first
    character to its last, joined by line breaks. Only fitting looks at spans; texts are scored whole."""
    span = max(1, chars // SPANS)
    spread = f"transform(sequence(0, {SPANS - 1}), i -> substring(`{text}`, cast(1 + i * (length(`{text}`) - {span}) div {SPANS - 1} as int), {span}))"
    return F.when(F.length(text) <= chars, F.col(text)).otherwise(F.expr(f"array_join({spread}, '\\n')"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, keep_sql: str, id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, dict]:
    """(texts, labels, rows per label before sampling) of up to ``per_class`` documents a label value, those of least hash of the id.

    ``keep_sql`` says which ids may be learnt from. An id that has several labels has the greatest of them; an id that has several
    texts gives the least of them. What comes to the driver is bounded by ``per_class`` texts a label and ``spans_of(chars)``.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(keep_sql).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    if not counts:
        return [], np.zeros(0), {}
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(label_col)), F.lit(DRAWS))
    share = F.create_map(*[x for label, n in counts.items() for x in (F.lit(label), F.lit(drawing_bound(per_class, n)))])
    least = F.row_number().over(Window.partitionBy("__label").orderBy("__drawn", id_col))
    chosen = known.withColumn("__drawn", drawn).where(F.col("__drawn") < share[F.col("__label")]).withColumn("__place", least).where(F.col("__place") <= per_class).select(id_col, "__label")
    text = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(chosen), id_col)
    found = text.select(id_col, "__label", spans_of("__text", chars).alias("__text")).groupBy(id_col).agg(F.min("__text").alias("__text"), F.max("__label").alias("__label"))
    rows = sorted((r[0], r[1], r[2]) for r in found.collect())
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    return [rows[i][1] for i in order], np.array([rows[i][2] for i in order], dtype=np.float64), counts


def blocks(texts: list[bytes], size: int = 1 << 19) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, so that what is computed of all words is held for one range at a time."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            out.append((start, i))
            start, held = i, 0
        held += len(t) + 1
    return out + [(start, len(texts))] if texts else out


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.w, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.w[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.w[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cross_entropy(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.sum(weight * (np.logaddexp(0, logits) - y * logits)) / np.sum(weight))


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least cross-entropy, from a grid in logarithmic steps."""
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    return float(grid[int(np.argmin([cross_entropy(logits / t, y, weight) for t in grid]))]) if len(y) else 1.0
