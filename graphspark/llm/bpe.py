"""Byte-level BPE encoding and decoding.

Method: a hierarchical-bitmap rank queue. The mergeable pairs of a pre-token live in
buckets, one per merge rank, that hold positions of a linked list over the bytes. A
two-level bitmap marks the ranks whose bucket isn't empty; find-first-set on its top
and then on one word below gives the next rank. A bucket is gone through from its
leftmost position; an entry whose pair has changed since is stale and skipped. A
pre-token of n bytes costs O(n) queue operations, however long it is.

Texts are split by the pattern and each match is encoded separately: the short
matches of a batch of texts share one queue, in which a barrier between two matches
belongs to no pair, so that their merges don't touch each other. Matches are
remembered in a bounded table per worker.

Defined results: null text is the empty text (no ids); text is never a special
token; rows that repeat are encoded each on its own; a text of any length is encoded
whole (about 100 bytes of memory a byte of its longest match); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import column, slices, strings
from graphspark.session import ensure_importable

#: Matches whose ids a worker remembers in each of two generations, and the longest such match.
CACHED_MATCHES, CACHED_LENGTH = 500_000, 64
#: Bytes of matches that share a queue.
BATCH = 1 << 18

_WORD = 8  # ranks in one word of the lower level: 2 ** 8


class RankQueue:
    """Ranks with buckets of positions; gives the lowest rank and its positions from left to right."""

    __slots__ = ("top", "words", "buckets")

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, array] = {}

    def add(self, rank: int, positions: array) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        group = rank >> _WORD
        self.top |= 1 << group
        self.words[group] = self.words.get(group, 0) | 1 << (rank & 255)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.add(rank, array("i", (position,)))
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]]:
        top = self.top
        group = (top & -top).bit_length() - 1
        word = self.words[group]
        low = (word & -word).bit_length() - 1
        rank = group << _WORD | low
        word ^= 1 << low
        if word:
            self.words[group] = word
        else:
            del self.words[group]
            self.top = top ^ 1 << group
        return rank, sorted(self.buckets.pop(rank))


class ByteBpe:
    """Encoder and decoder for a table of ranks and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is used again moves up
        self.spelled: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for spelling, i in ranks.items():
            self.spelled[i] = spelling
        self.names = [b"%d" % i for i in range(len(self.spelled))]
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.pairs = np.full(1 << 16, -1, dtype=np.int32)
        for spelling, i in ranks.items():
            if len(spelling) == 2:
                self.pairs[int.from_bytes(spelling, "big")] = i

    @classmethod
    def from_lines(cls, lines: Iterable[bytes], pattern: str) -> ByteBpe:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def encode_matches(self, matches: list[bytes]) -> list[np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of matches of the pattern, none of them empty, by one queue."""
        ends = np.cumsum([len(m) + 1 for m in matches])  # a barrier follows each match
        data, n = b"\0".join([*matches, b""]), int(ends[-1])
        barrier = ends - 1
        raw = np.frombuffer(data, dtype=np.uint8)
        ids = self.single[raw]
        ids[barrier] = -1
        rank_of = np.full(n, -1, dtype=np.int32)  # of a node with its successor
        rank_of[:-1] = self.pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        rank_of[barrier] = -1
        rank_of[barrier[barrier > 0] - 1] = -1
        queue = RankQueue()
        at = np.argsort(rank_of, kind="stable").astype(np.int32)
        at = at[np.count_nonzero(rank_of < 0) :]
        cuts = np.flatnonzero(np.diff(rank_of[at])) + 1
        for part in np.split(at, cuts) if len(at) else []:
            queue.add(int(rank_of[part[0]]), array("i", part.tobytes()))
        token, pair = array("i", ids.tobytes()), array("i", rank_of.tobytes())
        after, before = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        blocked = bytearray(n + 1)
        for b in barrier.tolist():
            blocked[b] = 1
        push, get = queue.push, self.ranks.get
        while queue.top:
            rank, positions = queue.pop()
            for k, i in enumerate(positions):
                if pair[i] != rank:
                    continue  # stale
                lower = False
                gone = after[i]
                end = after[gone]
                token[i], token[gone], pair[gone] = rank, -1, -1
                after[i], before[end] = end, i
                if blocked[end]:
                    pair[i] = -1
                else:
                    new = get(data[i : after[end]])
                    if new is None:
                        pair[i] = -1
                    else:
                        pair[i] = new
                        push(new, i)
                        lower = new < rank
                left = before[i]
                if left >= 0 and not blocked[left]:
                    new = get(data[left:end])
                    if new is None:
                        pair[left] = -1
                    else:
                        pair[left] = new
                        push(new, left)
                        lower = lower or new < rank
                if lower and k + 1 < len(positions):  # a merge that comes before the rest of this bucket
                    queue.add(rank, array("i", positions[k + 1 :]))
                    break
        token = np.frombuffer(token, dtype=np.int32)
        kept = np.flatnonzero(token >= 0)
        return np.split(token[kept].astype("<u4"), np.searchsorted(kept, barrier[:-1]))

    def _learn(self, matches: list[str]) -> None:
        """Adds the ids of matches that aren't in the table."""
        known, older, get, batch, size = self.known, self.older, self.ranks.get, [], 0

        def flush():
            for m, ids in zip(batch, self.encode_matches([m.encode() for m in batch]), strict=True):
                known[m] = ids.tobytes()
            batch.clear()

        for m in matches:
            ids = older.get(m)
            if ids is None:
                whole = get(m.encode())
                if whole is None:
                    batch.append(m)
                    size += len(m)
                    if size > BATCH:
                        flush()
                        size = 0
                    continue
                ids = whole.to_bytes(4, "little")
            known[m] = ids
        if batch:
            flush()

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, little-endian unsigned 32-bit."""
        found = list(map(self.find, texts))
        if len(self.known) > CACHED_MATCHES:
            self.known, self.older = {}, self.known
        known = self.known
        missing = set().union(*found)
        missing.difference_update(known.keys() & missing)
        self._learn(list(missing))
        out = [np.frombuffer(b"".join(map(known.__getitem__, matches)), dtype="<u4") for matches in found]
        for m in missing:
            if len(m) > CACHED_LENGTH:
                del known[m]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def spell_ids(self, ids: list[int]) -> bytes:
        """Decimal ids joined by one space."""
        return b" ".join(map(self.names.__getitem__, ids))


def coder(path: str, pattern: str) -> ByteBpe:
    """One per worker process and rank file."""
    own = coder.__dict__.setdefault("own", {})
    if (path, pattern) not in own:
        with open(path, "rb") as lines:
            own[path, pattern] = ByteBpe.from_lines(lines, pattern)
    return own[path, pattern]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded (binary)."""
    ensure_importable(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema["__id"].dataType
    schema = pa.schema([("__id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []))

    def encoded(batches):
        own = coder(rank_path, pattern)
        for batch in slices(batches, "__text"):
            n, spelled, plain, all_ids, all_bytes = [], [], [], [], []
            for ids in own.encode_texts(strings(batch, "__text")):
                ids = ids.tolist()
                back = own.decode(ids)
                n.append(len(ids))
                spelled.append(hashlib.sha256(own.spell_ids(ids)).hexdigest())
                plain.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_bytes.append(back)
            out = [column(batch, "__id"), pa.array(n, pa.int64()), pa.array(spelled), pa.array(plain)]
            if with_ids:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    extra = ", ids array<int>, decoded binary" if with_ids else ""
    return source.mapInArrow(encoded, f"__id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("__id", id_col)


def decode_ids(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids spells; null ids give null."""
    ensure_importable(df.sparkSession)

    @F.pandas_udf("binary")
    def spelled(ids):
        own = coder(rank_path, pattern)
        return ids.map(lambda x: None if x is None else own.decode(list(x)))

    return df.withColumn(out_col, spelled(F.col(ids_col)))
