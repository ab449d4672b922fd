"""Best-fit packing of token pieces into fixed-length sequences.

Method: bounded-space online best-fit. A packer holds a fixed number of open
bins in a bitset keyed by free space: bit f is set while some open bin has f free
tokens, so the best bin for a piece of n tokens is the lowest set bit at or above
n. When every slot is taken and nothing fits, the fullest open bin closes first.

Each partition packs its own pieces (no shuffle of texts); pieces arrive in blocks
sorted by falling length, which the online packer then takes one by one. What lies
in bins that a packer leaves with 1/256 of free space or more is packed once more
by the same packer, piece by piece over few tasks (rows of a few numbers, no texts),
so that many partitions cost no sequences.

Defined results: null text is the empty text (one piece, the separator alone);
rows that repeat are packed each on its own; ids may be null or repeat; pieces of
one length stay in the order they come in; a text of any length is encoded whole
(about 20 bytes of memory a byte of it) and cut; a text that holds the literal of an
added token of the file gives that token, as the library does; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import byte_list, column, slices
from graphspark.session import ensure_importable, materialize, release

#: Pieces that are sorted by length at a time; memory of a packer is bounded by this and its open bins.
BLOCK = 65_536
#: Pieces that one task of the second round packs.
GROUP = 200_000
#: Words whose ids a worker remembers in each of two generations, and the longest such word.
CACHED_WORDS, CACHED_LENGTH = 200_000, 64


class BestFit:
    """Bounded-space online best-fit over bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.closed: list[tuple[int, int]] = []  # (bin, free) of bins that closed before they were full

    def _take(self, free: int) -> int:
        level = self.by_free[free]
        found = level.pop()
        if not level:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``length``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.count >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.closed.append((self._take(fullest), fullest))
                self.count -= 1
            chosen, free = self.made, self.capacity
            self.made += 1
            self.count += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(chosen)
            self.bits |= 1 << rest
        else:
            self.count -= 1
        return chosen, self.capacity - free

    def left(self) -> Iterator[tuple[int, int]]:
        """(bin, free) of every bin that isn't full."""
        yield from self.closed
        for free, level in enumerate(self.by_free):
            for b in level:
                yield b, free


class WordIds:
    """Token ids of whole texts, many texts at a time.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its
    white-space-separated words in order. Neither does it join a letter to a sign after it, so words are cut there too.
    Arrow splits the texts and numbers their distinct words; each of these is looked up in a bounded table, and what is
    new goes through the tokenizers library. The texts' ids are then gathered from those of the distinct words. A text
    that holds the literal of an added token goes through the library as a whole.
    """

    #: What stands for a text's end among the ids; no vocabulary has it.
    END_ID = 0xFFFFFFFF
    #: A letter and a sign after it. An apostrophe isn't among the signs, as it may begin a contraction.
    CUT = r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~])"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True  # a word that only looks like an added token in lower case
        self.encode_batch = getattr(words, "encode_batch_fast", words.encode_batch)  # without offsets
        vocabulary = words.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = re.compile("[a-zß-öø-ÿ]+").fullmatch
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before; what is used again moves up

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The ids of all texts as one array, each text's ids followed by END_ID; null is the empty text."""
        low = pc.ascii_lower(pc.fill_null(texts, ""))
        for literal in self.literals:
            found = pc.index(pc.match_substring(low, literal), True).as_py()
            if found >= 0:
                own = self.tokenizer.encode(texts[found].as_py(), add_special_tokens=False).ids
                rest = [self(x) for x in (texts[:found], texts[found + 1 :]) if len(x)]
                return np.concatenate([*rest[: found > 0], np.array([*own, self.END_ID], dtype="<u4"), *rest[found > 0 :]])
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=self.CUT, replacement=r"\1 \2"))
        ends, words = split.offsets.to_numpy()[1:], split.values.dictionary_encode()
        distinct = byte_list(words.dictionary.cast(pa.binary()))
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        missing = [w for w in distinct if w not in known]
        self._learn(missing)
        spelled = list(map(known.__getitem__, distinct))
        for w in missing:
            if len(w) > CACHED_LENGTH:
                del known[w]
        # one more word, the end, after the words of each text; then every word's ids are gathered from the distinct words'
        ids = np.frombuffer(b"".join([*spelled, self.END_ID.to_bytes(4, "little")]), dtype="<u4")
        length = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)) // 4
        length = np.append(length, 1)
        start = np.cumsum(length) - length
        at = np.insert(words.indices.to_numpy(zero_copy_only=False), ends, len(distinct))
        n = length[at]
        stop = np.cumsum(n)
        return ids[np.repeat(start[at] - (stop - n), n) + np.arange(stop[-1])]

    def _learn(self, missing: list[bytes]) -> None:
        """Adds the ids of words that aren't in the table. Words of letters alone are one match of the tokenizer's pattern,
        which ends with an end-of-word token; many are encoded as one text and cut there. The others, and texts that don't
        cut as they should, are encoded word by word."""
        known, older, alone, joined = self.known, self.older, [], []
        for w in missing:
            ids = older.get(w)
            if ids is not None:
                known[w] = ids
            else:
                text = w.decode()
                (joined if self.letters(text) else alone).append((w, text))
        for at in range(0, len(joined), 256):
            part = joined[at : at + 256]
            ids = np.array(self.encode_batch([" ".join([x for _, x in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(stops) != len(part):
                alone += part
                continue
            data, start = ids.tobytes(), 0
            for (w, _), stop in zip(part, stops.tolist(), strict=True):
                known[w] = data[start:stop]
                start = stop
        for at in range(0, len(alone), 1024):
            part = alone[at : at + 1024]
            for (w, _), e in zip(part, self.encode_batch([x for _, x in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()


def _word_ids(path: str) -> WordIds:
    """One per worker process."""
    own = _word_ids.__dict__.setdefault("own", {})
    if path not in own:
        own[path] = WordIds(path)
    return own[path]


#: A placed piece, and (with nulls but for ``length`` and ``bin``) a bin that may be packed once more.
def _piece_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())])


class BlockPacker:
    """Collects pieces (batches of the first five columns of a piece) and packs them in blocks of falling length."""

    def __init__(self, id_type: pa.DataType, capacity: int, open_bins: int, first_bin: int):
        self.schema, self.packer, self.first_bin, self.alone = _piece_schema(id_type), BestFit(capacity, open_bins), first_bin, 0
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows >= BLOCK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        pieces = pa.Table.from_batches(self.held).combine_chunks()
        self.held, self.rows = [], 0
        order = np.argsort(-pieces.column("length").to_numpy(), kind="stable")
        pieces = pieces.take(pa.array(order))
        place, capacity, bins, offsets = self.packer.place, self.packer.capacity, [], []
        for length in pieces.column("length").to_pylist():
            if length == capacity:  # a bin of its own
                self.alone += 1
                bins.append(-self.alone)
                offsets.append(0)
            else:
                chosen, offset = place(length)
                bins.append(chosen)
                offsets.append(offset)
        columns = [pieces.column(i).combine_chunks() for i in range(5)]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(bins, dtype=np.int64) + self.first_bin), pa.array(offsets, pa.int64())], schema=self.schema)


def cut(ids: np.ndarray, separator: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length, crc) of every piece of texts' ids as ``WordIds`` gives them."""
    ends = np.flatnonzero(ids == WordIds.END_ID) + 1
    ids = np.where(ids == WordIds.END_ID, np.uint32(separator), ids).astype("<u4")
    lengths = np.diff(np.concatenate(([0], ends)))
    pieces = -(-lengths // capacity)
    text = np.repeat(np.arange(len(ends)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(capacity, lengths[text] - start)
    first = (ends - lengths)[text] + start
    data = memoryview(ids).cast("B")
    crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip((first * 4).tolist(), ((first + length) * 4).tolist(), strict=True)), dtype=np.int64, count=len(text))
    return text, piece, start, length, crc


def _packed_partition(batches, id_type: pa.DataType, text_col: str, tokenizer_path: str, separator: int, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    encode, first_bin = _word_ids(tokenizer_path), (2 * TaskContext.get().partitionId() + 1) << 38
    blocks = BlockPacker(id_type, capacity, open_bins, first_bin)
    for batch in slices(batches, text_col, rows=1 << 16, size=8 << 20):
        text, piece, start, length, crc = cut(encode(column(batch, text_col)), separator, capacity)
        yield from blocks.add(pa.RecordBatch.from_arrays([column(batch, "__id").take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], names=blocks.schema.names[:5]))
    yield from blocks.flush()
    left = [(b, free) for b, free in blocks.packer.left() if free * 256 >= capacity]
    for at in range(0, len(left), BLOCK):  # rows without a piece: the bins that may be packed once more
        part = left[at : at + BLOCK]
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in list(blocks.schema)[:3]] + [pa.array([capacity - free for _, free in part], pa.int64()), pa.nulls(n, pa.int64()), pa.array([first_bin + b for b, _ in part], pa.int64()), pa.nulls(n, pa.int64())], schema=blocks.schema)


def _repacked_partition(batches, id_type: pa.DataType, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """Pieces of unfilled bins into new bins; bins of this round have negative numbers."""
    blocks = BlockPacker(id_type, capacity, open_bins, -((TaskContext.get().partitionId() + 1) << 40))
    for batch in batches:
        yield from blocks.add(batch)
    yield from blocks.flush()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0, open_bins: int = 65_536) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of over ``capacity`` tokens (with the separator) are cut.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()

    arrow_type = to_arrow_type(source.schema["__id"].dataType)

    def packed(batches):
        yield from _packed_partition(batches, arrow_type, "__text", tokenizer_path, separator, capacity, open_bins)

    def repacked(batches):
        yield from _repacked_partition(batches, arrow_type, capacity, open_bins)

    form = f"doc {id_type}, piece int, start long, length long, ids_crc32 long, bin long, offset long"
    placed = materialize(source.mapInArrow(packed, form), "packed")
    left = placed.where("piece is null").select("bin", F.lit(True).alias("open"))
    marked = materialize(placed.where("piece is not null").join(left, "bin", "left"), "marked")
    release(placed)
    again = marked.where("open").select("doc", "piece", "start", "length", "ids_crc32")
    groups = max(1, -(-again.count() // GROUP))
    out = marked.where("open is null").select("doc", "piece", "start", "length", "ids_crc32", "bin", "offset").unionByName(again.repartition(groups).mapInArrow(repacked, form))
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
