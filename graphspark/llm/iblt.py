"""Document fingerprints: invertible Bloom lookup sketches of paragraph cells.

A paragraph cell is up to eight words of one line; its digest is 40 bits of a hash
of its bytes and of how often it came before in the document. Each digest is added
to three cells of the sketch (count, xor of digests, xor of check values). Two
versions' sketches subtract cell by cell; peeling cells that hold one digest
recovers the digests that differ; if cells are left over, both versions are
sketched four times larger and peeled again, a bounded number of times.

The fingerprint is the sketch at its base size. Likeness is the Jaccard index of
the two sets of digests, from their sizes and the recovered difference.

All documents of a slice are sketched and peeled together in numpy.

Defined results: null text is the empty text; two texts without words are alike
(1.0); the next document of the last is the first, of a single one itself; rows of
one id are ordered by a hash of their text, so rows that repeat follow each other;
null ids come last;
a text of any length is taken whole, in ranges; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import WordRuns, avalanche, slices, strings, values
from graphspark.session import ensure_importable, materialize

WORDS = 8
BASE = 24
ROUNDS = 1_000
_DIGEST = np.uint64((1 << 40) - 1)
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


#: Bytes of texts whose words are looked at together; a longer text goes through in ranges of this size.
RANGE = 1 << 20


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first byte in its text) of every cell, in order."""
    runs = WordRuns(texts)
    n = len(runs.start)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    line = np.cumsum(runs.data == 10)[runs.start]
    index = np.arange(n)
    new_line = np.concatenate(([True], line[1:] != line[:-1]))
    within = index - np.maximum.accumulate(np.where(new_line, index, 0))
    first = np.flatnonzero(within % WORDS == 0)
    last = np.concatenate((first[1:], [n])) - 1
    doc = runs.doc[first]
    begins = np.concatenate(([0], runs.ends[:-1]))[doc]
    return doc, runs.hashes(spans=(runs.start[first], runs.end[last])), runs.start[first] - begins


def cell_hashes(texts: list[bytes], size: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every cell. A range of a long text ends before its last cell, which may go on, and the next range
    begins there; a cell that fills a range makes the range longer."""
    docs, hashes, group, held = [], [], [], 0

    def flush():
        if group:
            doc, h, _ = _cells([texts[i] for i in group])
            docs.append(np.array(group)[doc])
            hashes.append(h)
            group.clear()

    for i, text in enumerate(texts):
        if len(text) <= size:
            if held + len(text) > size:
                flush()
                held = 0
            group.append(i)
            held += len(text)
            continue
        flush()
        held, at, span = 0, 0, size
        while at < len(text):
            _, h, first = _cells([text[at : at + span]])
            if at + span < len(text):
                if len(h) < 2 and len(h):  # one cell all along
                    span *= 2
                    continue
                h, step = h[:-1], int(first[-1]) if len(first) else span
            else:
                step = span
            docs.append(np.full(len(h), i))
            hashes.append(h)
            at, span = at + step, size
    flush()
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


class Digests:
    """Digests of the paragraph cells of several texts: ``doc`` and ``digest``, in order and distinct in each text.

    Two cells whose 40-bit digests agree by chance count as one, so that a sketch never holds a digest twice.
    """

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        doc, h = cell_hashes(texts)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        index = np.arange(len(h))
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))[: len(h)]
        rank = index - np.maximum.accumulate(np.where(again, 0, index)) if len(h) else index
        self._set(doc, avalanche(h + rank.astype(np.uint64) * _SEEDS[0]) & _DIGEST)

    @classmethod
    def of(cls, doc: np.ndarray, digest: np.ndarray, n_docs: int) -> Digests:
        """Of digests that are known already."""
        out = object.__new__(cls)
        out.n_docs = n_docs
        out._set(doc.astype(np.int64), digest.astype(np.uint64) & _DIGEST)
        return out

    def _set(self, doc: np.ndarray, digest: np.ndarray) -> None:
        order = np.lexsort((digest, doc))
        doc, digest = doc[order], digest[order]
        first = np.concatenate(([True], (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])))[: len(doc)]
        self.doc, self.digest = doc[first], digest[first]
        self.sizes = np.bincount(self.doc, minlength=self.n_docs)

    def of_text(self, i: int) -> np.ndarray:
        return self.digest[slice(*np.searchsorted(self.doc, [i, i + 1]))]

    def only(self, docs: np.ndarray) -> Digests:
        """Those of some texts, numbered anew in the given order."""
        number = np.full(self.n_docs, -1)
        number[docs] = np.arange(len(docs))
        out = object.__new__(Digests)
        keep = number[self.doc] >= 0
        out.doc, out.digest, out.n_docs, out.sizes = number[self.doc[keep]], self.digest[keep], len(docs), self.sizes[docs]
        return out


def check_values(digest: np.ndarray) -> np.ndarray:
    return avalanche(digest + _SEEDS[1]) & np.uint64(0xFFFF)


def places(doc: np.ndarray, digest: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each third of its document's sketch; shape (3, n)."""
    third = np.uint64(cells // 3)
    h = avalanche(digest + np.uint64(int(_SEEDS[2]) * cells % (1 << 64)))
    return np.stack([doc * cells + j * (cells // 3) + ((h >> np.uint64(21 * j)) % third).astype(np.int64) for j in range(3)])


class Sketches:
    """One sketch of ``cells`` cells per document."""

    def __init__(self, n_docs: int, cells: int):
        self.n_docs, self.cells = n_docs, cells
        self.count = np.zeros(n_docs * cells, dtype=np.int64)
        self.key = np.zeros(n_docs * cells, dtype=np.uint64)
        self.check = np.zeros(n_docs * cells, dtype=np.uint64)

    def add(self, doc: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check, sign = check_values(digest), np.broadcast_to(np.asarray(sign, dtype=np.int64), doc.shape)
        for at in places(doc, digest, self.cells):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n_docs, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def packed(self) -> list[bytes]:
        """Per document: 8 bytes a cell, which are the count modulo 256, 40 bits of digests and 16 of check values."""
        words = (self.count.astype(np.uint64) << np.uint64(56)) | (self.key << np.uint64(16)) | self.check
        return [row.tobytes() for row in words.astype(">u8").reshape(self.n_docs, self.cells)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, digest, sign) of what is recovered, and which documents' sketches are empty afterwards."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            one = np.flatnonzero((np.abs(self.count) == 1) & (self.check == check_values(self.key)))
            if not len(one):
                break
            doc, digest, sign = one // self.cells, self.key[one], self.count[one]
            mine = (places(doc, digest, self.cells) == one).any(axis=0)
            doc, digest, sign, one = doc[mine], digest[mine], sign[mine], one[mine]
            if not len(one):
                break
            order = np.lexsort((digest, doc))
            doc, digest, sign = doc[order], digest[order], sign[order]
            first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])))
            doc, digest, sign = doc[first], digest[first], sign[first]
            self.add(doc, digest, -sign)
            found.append((doc, digest, sign))
            if len(found) > ROUNDS:  # cells that lie; the documents that aren't empty are tried larger
                break
        clean = ~((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.n_docs, self.cells).any(axis=1)
        if not found:
            found.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), clean)


def differences(a: Digests, b: Digests, base: int = BASE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document: digests that only ``a`` has and that only ``b`` has, recovered by peeling.

    What can't be peeled is sketched four times larger, up to four cells a digest; a document that isn't recovered there
    either (cells that lie) is told apart by its sorted digests, so that this ends whatever the digests are.
    """
    out: list = [None] * a.n_docs
    left, cells = np.arange(a.n_docs), base
    while len(left):
        large = cells > base + 16 * (a.sizes[left] + b.sizes[left])
        for i in left[large]:
            own, other = a.of_text(i), b.of_text(i)
            out[i] = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
        left = left[~large]
        own_a, own_b = a.only(left), b.only(left)
        sketch_a, sketch_b = Sketches(len(left), cells), Sketches(len(left), cells)
        sketch_a.add(own_a.doc, own_a.digest)
        sketch_b.add(own_b.doc, own_b.digest)
        doc, digest, sign, clean = sketch_a.minus(sketch_b).peel()
        order = np.argsort(doc, kind="stable")
        doc, digest, sign = doc[order], digest[order], sign[order]
        ends = np.searchsorted(doc, np.arange(len(left) + 1))
        for i in np.flatnonzero(clean):
            d, s = digest[ends[i] : ends[i + 1]], sign[ends[i] : ends[i + 1]]
            out[left[i]] = (d[s > 0], d[s < 0])
        left = left[~clean]
        cells *= 4
    return out


def likeness(a: Digests, b: Digests, base: int = BASE) -> np.ndarray:
    apart = np.array([len(x) + len(y) for x, y in differences(a, b, base)], dtype=np.float64)
    total = (a.sizes + b.sizes).astype(np.float64)
    return np.where(total + apart > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def base_sketches(d: Digests, base: int = BASE) -> list[bytes]:
    s = Sketches(d.n_docs, base)
    s.add(d.doc, d.digest)
    return s.packed()


def edited_text(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare(texts: list[str], others: list[str]) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per text and the document after it."""
    edited = [edited_text(t, o).encode() for t, o in zip(texts, others, strict=True)]
    a, e, o = Digests([t.encode() for t in texts]), Digests(edited), Digests([t.encode() for t in others])
    return list(zip([len(t) for t in texts], [hashlib.sha256(x).hexdigest() for x in edited], base_sketches(a), base_sketches(e), likeness(a, e).tolist(), likeness(a, o).tolist(), strict=True))


_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_SQL = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next.

    Texts are dealt once, by range of the id; a partition compares each document with the one after it and
    leaves its first and last documents to a second step over two documents a partition.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    source = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kind = source.schema["__id"].dataType
    arrow_kind = to_arrow_type(kind)
    schema = pa.schema([("edge", pa.string()), ("part", pa.int32()), ("__id", arrow_kind), ("__text", pa.string()), *_RESULT])

    def in_order(batches):
        part, held = TaskContext.get().partitionId(), None

        def edge(name, doc, text):
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([doc], arrow_kind), pa.array([text], pa.string())] + [pa.nulls(1, t) for _, t in _RESULT], schema=schema)

        for batch in slices(batches, "__text", rows=256, size=1 << 20):
            ids, texts = values(batch, "__id"), strings(batch, "__text")
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(ids) > 1:
                rows = compare(texts[:-1], texts[1:])
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(ids[:-1], arrow_kind), pa.nulls(n, pa.string()), *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _RESULT, strict=True))], schema=schema)
            held = ids[-1], texts[-1]
        if held is not None:
            yield edge("last", *held)

    def at_edges(batches):
        out = pa.schema([("__id", arrow_kind), *_RESULT])
        for batch in slices(batches, "__text", rows=64, size=1 << 20):
            rows = compare(strings(batch, "__text"), strings(batch, "next_text"))
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "__id"), arrow_kind), *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _RESULT, strict=True))], schema=out)

    # rows of one id may be many, so a hash of the text and a row number tell them apart in the ranges
    order = F.desc("__id"), F.col("__hash"), F.col("__row")
    keyed = source.withColumns({"__hash": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__text")
    done = materialize(dealt.mapInArrow(in_order, f"edge string, part int, __id {kind.simpleString()}, __text string, {_RESULT_SQL}"), "fingerprints")
    firsts = done.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("__text").alias("next_text"))
    everything = Window.orderBy("next_part")  # a number per partition
    after = firsts.select("next_part").select(F.col("next_part").alias("part"), F.coalesce(F.lead("next_part").over(everything), F.min("next_part").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    edges = done.where("edge = 'last'").select("part", "__id", "__text").join(after, "part").join(firsts, "next_part").select("__id", "__text", "next_text")
    rows = done.where("edge is null").select("__id", *(n for n, _ in _RESULT)).union(edges.mapInArrow(at_edges, f"__id {kind.simpleString()}, {_RESULT_SQL}"))
    return rows.select(F.col("__id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
