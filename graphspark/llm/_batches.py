"""Arrow batches in small bounded slices, and byte-level token hashing in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the contracts: \x20 and \x09-\x0D, which is what bytes.split() takes.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterable[pa.RecordBatch], text: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice has more than ``rows`` rows or, beyond its first row, ``size`` bytes of ``text``."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = max(start + 1, min(stop, start + rows, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    arr = column(batch, name)
    return [x or b"" for x in arr.cast(pa.large_binary() if pa.types.is_large_string(arr.type) else pa.binary()).to_pylist()]


def byte_list(words: pa.Array) -> list[bytes]:
    """A binary array whose values hold no space, as a list."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py().split(b" ") if len(words) else []


def ranges(text: bytes, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of a text of at most ``size`` bytes, cut after white space; a run without any that is longer than
    ``size`` is cut between two characters."""
    start = 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            yield start, len(text)
            return
        last = max(text.rfind(c, start, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if last > start:
            end = last + 1
        else:
            while end > start + 1 and text[end] & 0xC0 == 0x80:
                end -= 1
        yield start, end
        start = end


_UNBROKEN = re.compile(rb"[^ \t-\r]{4096}")


def broken(text: bytes) -> bytes:
    """With a space after every 4,096 bytes of a run that has no white space, so that no word is longer."""
    return _UNBROKEN.sub(rb"\g<0> ", text)


def avalanche(h: np.ndarray) -> np.ndarray:
    """Mix 64-bit hashes (finalizer of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse modulo 2**64; kept per process."""
    own = _powers.__dict__.get("own")
    if own is None or len(own[0]) <= n:
        own = []
        for base in (_MULT, np.uint64(pow(int(_MULT), -1, 1 << 64))):
            p = np.full(max(n, 1 << 20) + 1, base, dtype=np.uint64)
            p[0] = 1
            own.append(np.multiply.accumulate(p))
        _powers.__dict__["own"] = own
    return own[0][: n + 1], own[1][: n + 1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, modulo 2**64."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0][:-1], out=total[1:])
    return total


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial by prefix sums, then mixed."""
    total = prefix_sums(data) if prefix is None else prefix
    return avalanche((total[end] - total[start]) * _powers(len(data))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class WordRuns:
    """The words of several texts as flat arrays: ``doc``, ``start``, ``end`` in ``data``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1)  # each text and the line break after it
        word = ~SPACES[self.data]
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.n_docs = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self, data: np.ndarray | None = None, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes of each word (or of each span): a polynomial by prefix sums, then mixed."""
        start, end = (self.start, self.end) if spans is None else spans
        return span_hashes(self.data if data is None else data, start, end)


def crc_remainder_sql(column_name: str, modulus: int) -> str:
    """Spark SQL for crc32 of an id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return f"pmod(crc32(cast(coalesce(cast(`{column_name}` as string), '') as binary)), {modulus})"
