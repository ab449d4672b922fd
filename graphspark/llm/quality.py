"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: every word has a fixed sparse ternary index vector; a word's
vector is its index vector plus the index vectors of the words around it, summed
over the training sample. Words are hashed into a fixed number of rows. A second
stream holds each word's shape (runs of letter case, digits and symbols collapsed,
marked where the word repeats the one before it), which makes noise visible in
words never seen before. A document is the mean of its words' vectors in both
streams; a two-layer numpy network scores it; a temperature fitted on a part of the
sample that the network hasn't seen calibrates the probabilities.

The training sample is bounded (``per_class`` documents a label, and of each no more
than ``chars`` characters, in spans spread over the whole text); every document is
scored on its whole text, a long one in ranges of RANGE bytes.

Defined results: null text is the empty text, whose pooled vector is zero and which
gets the network's score for it; without any labels the score is 0.5; rows that
repeat are scored each on its own; equal texts have equal scores; an id with several
labels has the greatest; a null id is never learnt from; in a text of over RANGE
bytes a run of over 4,096 bytes without white space counts as several words; an
empty table gives an empty result; other columns, among them lang and source, are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import SPACES, WordRuns, broken, column, crc_remainder_sql, ranges, slices, utf8
from graphspark.llm._training import SAMPLE_CHARS, Adam, blocks, cross_entropy, labelled_sample, sigmoid, temperature
from graphspark.session import ensure_importable

ROWS, DIM, NONZERO = 1 << 14, 48, 8
HIDDEN = 24
PER_CLASS = 1500
FOLDS = 5
#: Bytes of a text whose words are looked at together.
RANGE = 1 << 18

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def index_vectors(seed: int) -> np.ndarray:
    """Sparse ternary rows: NONZERO entries of +1 or -1 in DIM."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    at = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.float32), size=at.shape), axis=1)
    return out / np.sqrt(NONZERO)


def streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, row of the word, row of the shape) of every word."""
    runs = WordRuns(texts)
    if not len(runs.start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    words = runs.hashes()
    kind = _SHAPE[runs.data]
    keep = np.concatenate(([True], kind[1:] != kind[:-1])) | SPACES[runs.data]
    keep[runs.start] = True
    place = np.cumsum(keep)
    shapes = runs.hashes(kind[keep], (place[runs.start] - 1, place[runs.end - 1]))
    repeats = np.concatenate(([False], (words[1:] == words[:-1]) & (runs.doc[1:] == runs.doc[:-1])))
    shapes = shapes ^ (repeats.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    return runs.doc, (words % np.uint64(ROWS)).astype(np.int64), (shapes % np.uint64(ROWS)).astype(np.int64)


def add_context(context: np.ndarray, doc: np.ndarray, row: np.ndarray, index: np.ndarray, window: int = 2) -> None:
    """Adds to each row the index vectors of what stands within ``window`` words of its occurrences."""
    for gap in range(1, window + 1):
        near = doc[gap:] == doc[:-gap]
        a, b = row[gap:][near], row[:-gap][near]
        for to, of in ((a, b), (b, a)):
            pairs, times = np.unique(to * ROWS + of, return_counts=True)
            for at in range(0, len(pairs), 1 << 15):
                part = slice(at, at + (1 << 15))
                np.add.at(context, pairs[part] // ROWS, index[pairs[part] % ROWS] * times[part, None].astype(np.float32))


def word_vectors(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Index vectors plus contexts, both of length 1 before and the sum of length 1 after."""
    size = np.linalg.norm(context, axis=1, keepdims=True)
    out = index + np.where(size > 0, context / np.maximum(size, 1e-9), 0)
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def _sums(texts: list[bytes], vectors: tuple[np.ndarray, np.ndarray], skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words' and of the shapes' vectors, and the numbers of words; without the first ``skip`` words of a single text."""
    doc, *rows = streams(texts)
    doc, rows = doc[skip:], [r[skip:] for r in rows]
    out, n = np.zeros((len(texts), 2 * DIM), dtype=np.float32), np.bincount(doc, minlength=len(texts))
    if len(doc):
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for k in (0, 1):
            out[doc[first], k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[k][rows[k]], first, axis=0)
    return out, n


def _long_sums(text: bytes, vectors: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """As ``_sums`` of one text, range by range; each range sees the word before it, which a repeat is told by."""
    text = broken(text)
    total, words, before = np.zeros(2 * DIM), 0, b""
    for start, end in ranges(text, size):
        part = text[start:end]
        own, n = _sums([before + b" " + part], vectors, 1 if before else 0)
        total += own[0]
        words += int(n[0])
        before = (part.rstrip().rsplit(None, 1) or [before])[-1]
    return total.astype(np.float32), words


def pool(texts: list[bytes], vectors: tuple[np.ndarray, np.ndarray], size: int | None = None) -> np.ndarray:
    """Means of the words' and of the shapes' vectors; (documents, 2 * DIM)."""
    size = size or RANGE
    long = [i for i, t in enumerate(texts) if len(t) > size]
    out, n = _sums([b"" if len(t) > size else t for t in texts], vectors)
    for i in long:
        out[i], n[i] = _long_sums(texts[i], vectors, size)
    return out / np.maximum(n, 1)[:, None].astype(np.float32)


class Quality:
    """The fitted classifier."""

    def __init__(self, texts: list[bytes], y: np.ndarray, counts: dict):
        index = index_vectors(11), index_vectors(12)
        context = tuple(np.zeros_like(i) for i in index)
        for start, end in blocks(texts):
            doc, *rows = streams(texts[start:end])
            for c, row, i in zip(context, rows, index, strict=True):
                add_context(c, doc, row, i)
        self.vectors = tuple(word_vectors(c, i) for c, i in zip(context, index, strict=True))
        x = np.concatenate([np.zeros((0, 2 * DIM), np.float32), *(pool(texts[start:end], self.vectors) for start, end in blocks(texts))])
        self.fitted = len(set(y.tolist())) > 1
        if not self.fitted:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        # The classes are drawn evenly; weights give them back their shares among the labels.
        share = {k: counts[k] / max(1, int(np.sum(y == k))) for k in set(y.tolist())}
        weight = np.array([share[k] for k in y.tolist()])
        weight /= weight.mean()
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        own = np.arange(len(y)) % 5 != 0
        rng = np.random.default_rng(3)
        w = {"a": rng.normal(0, 0.1, (x.shape[1], HIDDEN)), "c": np.zeros(HIDDEN), "b": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        best, adam = (np.inf, None), Adam(w, 0.01, 1e-4)
        zt, yt, wt = z[own], y[own], weight[own]
        for epoch in range(120):
            for part in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 256)):
                h = np.tanh(zt[part] @ w["a"] + w["c"])
                e = (sigmoid(h @ w["b"] + w["d"]) - yt[part]) * wt[part] / max(1, len(part))
                back = np.outer(e, w["b"]) * (1 - h * h)
                adam.step({"a": zt[part].T @ back, "c": back.sum(axis=0), "b": h.T @ e, "d": np.array([e.sum()])})
            if epoch % 5 == 4:
                held = cross_entropy(np.tanh(z[~own] @ w["a"] + w["c"]) @ w["b"] + w["d"], y[~own], weight[~own]) if (~own).any() else 0.0
                if held < best[0]:
                    best = held, {k: v.copy() for k, v in w.items()}
        self.w = best[1] or w
        self.temperature = temperature(self._logits(z[~own]), y[~own], weight[~own])

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w["a"] + self.w["c"]) @ self.w["b"] + self.w["d"]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        return sigmoid(self._logits((pool(texts, self.vectors) - self.mean) / self.scale) / self.temperature)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS) -> Quality:
    texts, y, counts = labelled_sample(docs, labels, label_col, per_class, f"{crc_remainder_sql(id_col, FOLDS)} <> 0", id_col, text_col, chars)
    return Quality([t.encode() for t in texts], y, counts)


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted, by a fitted model with a ``score`` method over UTF-8 texts."""
    spark = docs.sparkSession
    ensure_importable(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size, whatever the corpus
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema["__id"].dataType
    schema = pa.schema([("__id", to_arrow_type(kind)), ("score", pa.float64())])

    def scored(batches):
        for batch in slices(batches, "__text", rows=128, size=1 << 18):
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array(np.asarray(sent.value.score(utf8(batch, "__text")), dtype=np.float64))], schema=schema)

    out = source.mapInArrow(scored, f"__id {kind.simpleString()}, score double").withColumnRenamed("__id", id_col)
    return out.select(id_col, F.expr(f"{crc_remainder_sql(id_col, FOLDS)} = 0").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    return score_documents(docs, fit_quality(docs, labels, **options), threshold=threshold)


def keep_documents(docs: DataFrame, model, keep, text_col: str = "text") -> DataFrame:
    """The whole rows of ``docs`` whose score ``keep`` accepts (a function of an array of scores); no shuffle."""
    spark = docs.sparkSession
    ensure_importable(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches):
        for batch in slices(batches, text_col, rows=128, size=1 << 18):
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep(np.asarray(sent.value.score(texts)))))

    return docs.mapInArrow(kept, docs.schema)
