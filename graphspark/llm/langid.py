"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one binary logistic classifier over
hashed byte n-grams (two to four bytes within words, lower-cased) predicts each
bit. Decoding adds, for each codeword, the losses of the bits' margins, weighted
by how often each bit's classifier is right for that language; the nearest
codeword wins, and a small lead over the second is flagged as ambiguous.

Up to seven languages get the exhaustive code; more get the best of fifty random
codes of 10 log2(k) bits. Every language is learnt. The training sample is bounded:
``per_lang`` documents a language, or, so that no more than SAMPLE of all languages
are held at once, an equal share of that and at least one; those of least hash of id
and text, and of each no more than ``chars`` characters, in spans spread over the
whole text. Every document is scored on its whole text, in ranges of RANGE bytes.

Defined results: a null text or one without letters is ``und`` with score 0; if
nothing can be learnt every document is ``und``; with a single language every text
with letters has it; of languages at equal loss the first in order wins; rows that
repeat are scored each on its own; equal texts have equal results; a null id is in
the training part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import column, crc_remainder_sql, slices, values
from graphspark.llm._training import DRAWS, SAMPLE_CHARS, Adam, drawing_bound, sigmoid, spans_of
from graphspark.session import ensure_importable

ROWS = 1 << 12
PER_LANG, SAMPLE = 700, 8192
#: Lead of the nearest codeword over the next, in mean loss a bit, below which a text is ambiguous.
AMBIGUOUS = 0.5
#: Bytes whose n-grams are looked at together.
RANGE = 1 << 19

_FOLD = np.full(256, 32, dtype=np.uint64)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[[65 + _c, 97 + _c]] = 97 + _c


def ngram_features(texts: list[bytes], size: int | None = None) -> np.ndarray:
    """Square roots of the shares of hashed n-grams; (documents, ROWS) of float32."""
    size = size or RANGE
    raw = np.frombuffer(b" ".join([b"", *texts, b"   "]), dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    total = int(ends[-1]) if len(texts) else 0
    out = np.zeros(len(texts) * ROWS, dtype=np.float32)
    for at in range(0, total, size):  # n-grams by their first byte
        n = min(size, total - at)
        data = _FOLD[raw[at : at + n + 3]]
        first, last = np.searchsorted(ends, [at, at + n - 1], side="right")
        edges = np.concatenate(([0], np.clip(ends[first : last + 1] - at, 0, n)))
        doc = np.repeat(np.arange(last - first + 1), np.diff(edges)) * ROWS
        held = np.zeros((last - first + 1) * ROWS, dtype=np.float32)
        gram = data[:n]
        for k in (1, 2, 3):
            gram = (gram << np.uint64(8)) | data[k : k + n]
            # grams within a word, or from the space before it
            inside = data[k : k + n] != 32
            for j in range(1, k):
                inside &= data[j : j + n] != 32
            row = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
            held += np.bincount((doc + row)[inside], minlength=len(held)).astype(np.float32)
        out[first * ROWS : (last + 1) * ROWS] += held
    out = out.reshape(len(texts), ROWS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def code_matrix(k: int) -> np.ndarray:
    """Codewords of k classes in +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        columns = [(1, *rest) for rest in product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(columns, dtype=np.float64).T
    rng, bits, best = np.random.default_rng(5), int(np.ceil(10 * np.log2(k))), (-1, None)
    for _ in range(50 if k < 300 else 1):
        m = rng.choice([-1.0, 1.0], size=(k, bits))
        apart = (bits - m @ m.T) / 2 + np.eye(k) * bits
        if apart.min() > best[0]:
            best = apart.min(), m
    return best[1]


class Languages:
    """The fitted classifiers and codewords."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.names = sorted(set(langs))
        self.code = code_matrix(len(self.names))
        if len(self.names) < 2:
            return
        number = {x: i for i, x in enumerate(self.names)}
        y = np.array([number[x] for x in langs])
        x = np.concatenate([ngram_features(texts[i : i + 128]) for i in range(0, len(texts), 128)])
        bits = (self.code[y] > 0).astype(np.float32)
        share = 1 / np.bincount(y)[y]
        share = (share / share.sum())[:, None].astype(np.float32)
        w = {"w": np.zeros((ROWS, bits.shape[1]), dtype=np.float32), "b": np.zeros(bits.shape[1], dtype=np.float32)}
        adam = Adam(w, 0.3)
        for _ in range(80):
            e = ((sigmoid(x @ w["w"] + w["b"]) - bits) * share).astype(np.float32)
            adam.step({"w": x.T @ e + 1e-6 * w["w"], "b": e.sum(axis=0)})
        self.w, self.b = w["w"], w["b"]
        right = (np.sign(x @ self.w + self.b) == self.code[y]).astype(np.float64)
        accuracy = np.stack([right[y == k].mean(axis=0) for k in range(len(self.names))]) + 1e-3
        self.weight = accuracy / accuracy.sum(axis=1, keepdims=True)

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """Weighted mean losses of every codeword; (documents, languages)."""
        margin = np.clip((ngram_features(texts) @ self.w + self.b).astype(np.float64), -30, 30)
        return np.logaddexp(0, -margin) @ (self.weight * (self.code > 0)).T + np.logaddexp(0, margin) @ (self.weight * (self.code < 0)).T

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) per text."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if len(self.names) == 1:
            return self.names * len(texts), np.ones(len(texts)), np.zeros(len(texts), dtype=bool)
        loss = self.losses(texts)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(texts))
        lead = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
        share = np.exp(-(loss - loss[rows, order[:, 0]][:, None]) * self.code.shape[1])
        return [self.names[i] for i in order[:, 0]], 1 / share.sum(axis=1), lead < AMBIGUOUS


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(c.isalpha() for c in text)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, modulus: int = 4, held: int = 2, chars: int = SAMPLE_CHARS) -> Languages:
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(lang_col).cast("string").alias("__lang")).where(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & F.expr(f"{crc_remainder_sql('__id', modulus)} <> {held}"))
    counts = {r[0]: r[1] for r in own.groupBy("__lang").count().collect()}  # a row a language
    if not counts:
        return Languages([], [])
    each = min(per_lang, max(1, SAMPLE // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(drawing_bound(each, n)))])
    drawn = own.withColumn("__drawn", F.xxhash64(F.col("__id").cast("string"), "__text")).where(F.pmod("__drawn", F.lit(DRAWS)) < share[F.col("__lang")])
    least = F.row_number().over(Window.partitionBy("__lang").orderBy("__drawn"))
    taken = drawn.where(F.col("__text").rlike(r"\p{L}")).select("__lang", "__drawn", spans_of("__text", chars).alias("__text")).dropDuplicates(["__lang", "__drawn"]).withColumn("__place", least).where(F.col("__place") <= each)
    pairs = sorted((r[0], r[1]) for r in taken.select("__lang", "__text").collect() if has_letter(r[1]))
    return Languages([t.encode() for _, t in pairs], [k for k, _ in pairs])


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, per_lang: int = PER_LANG, chars: int = SAMPLE_CHARS) -> DataFrame:
    """id, held_out, lang_pred, score, ambiguous."""
    spark = docs.sparkSession
    ensure_importable(spark)
    sent = spark.sparkContext.broadcast(fit_languages(docs, id_col, text_col, lang_col, per_lang, modulus, held, chars))  # ROWS x bits
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema["__id"].dataType
    schema = pa.schema([("__id", to_arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def named(batches):
        for batch in slices(batches, "__text", rows=256, size=1 << 19):
            texts = values(batch, "__text")
            known = [t is not None and has_letter(t) for t in texts]
            langs, scores, unsure = sent.value.predict([(t or "").encode() for t in texts])
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array([x if k else "und" for x, k in zip(langs, known, strict=True)]), pa.array(np.where(known, scores, 0.0)), pa.array(np.where(known, unsure, True))], schema=schema)

    out = source.mapInArrow(named, f"__id {kind.simpleString()}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("__id", id_col)
    return out.select(id_col, F.expr(f"{crc_remainder_sql(id_col, modulus)} = {held}").alias("held_out"), "lang_pred", "score", "ambiguous")
