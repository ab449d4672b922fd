"""Language-model scoring by a subword lattice.

A word (after a word-start mark) can be cut into vocabulary pieces in many ways. An
existing unigram vocabulary gives each piece a score; the scores weight all
segmentations, and a forward recursion in log space sums them: the marginal
probability of the word. Pieces don't cross words, so a text's log-probability is
the sum over its words, and an end mark. A character that the vocabulary lacks is
spelled by its byte pieces.

A vocabulary whose scores aren't log-probabilities (merge ranks) is read by Zipf's
law: rank r weighs 1 / (r + 2.7).

What the corpus adds: the vocabulary's scores are a prior that counts for PRIOR
pieces, and expectation-maximisation steps over the word counts of all training
documents fit the pieces to them (``fit_steps=0`` leaves the vocabulary's weights as
they are). The probability of every word comes from the lattice of pieces.
``word_arcs`` is an option that the registered query leaves off: a word that training
documents hold then has one more arc, the whole word, which weighs c / N times the
mass of known words; the pieces keep the mass that Good and Turing leave to unseen
words, the share of words that occur once, and are fitted to what the arcs of the
other occurrences don't explain.

Counts are exact over all documents: each partition counts its words before the
shuffle. To score texts, words that make up at least 1 / HOT of all tokens (so at
most HOT words) go to every worker; the others are joined by word, one row per
document and word.

A long word's lattice isn't held whole: the recursion goes through its arcs in ranges
and keeps one number a byte.

Defined results: null text is the empty text, which is scored as its end alone;
without training documents every word is unknown and the pieces keep the
vocabulary's own weights; rows that repeat, null ids and equal ids are scored each
on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import byte_list, column, crc_remainder_sql, prefix_sums, slices, span_hashes, values
from graphspark.session import ensure_importable, materialize, release

MARK = "▁"
PRIOR = 1_000.0
HOT = 60_000
FLUSH = 400_000
FLOOR = -1e30
WORDS_PER_TASK = 50_000
#: Distinct words that a partition of the join with the texts holds.
WORDS_PER_JOIN = 200_000
#: Slots of the table of pieces, and entries of a batch of lattices.
SLOTS, GRID = 1 << 18, 1 << 20
#: Longest word whose lattice is held whole, and the bytes of a longer one whose arcs are held at a time.
LONG, RANGE = 2_048, 1 << 14


class Pieces:
    """Pieces with natural log-probabilities, and the lattice recursions over them.

    Words are handled in batches of like length. A piece is found by a hash of its
    UTF-8 bytes in an open table; the word-start mark is one byte, a space.
    """

    def __init__(self, names: list[str], scores: list[float], spelled_bytes: dict[int, int], unused: set[int], log_scores: bool):
        raw = np.array(scores, dtype=np.float64)
        if not log_scores:
            raw = -np.log(np.argsort(np.argsort(-raw, kind="stable"), kind="stable") + 2.7)
        raw[list(unused)] = -np.inf
        self.end = len(names)  # the end of a text is one more piece, as likely as the likeliest before any fitting
        raw = np.append(raw, raw.max())
        self.logp = raw - np.logaddexp.reduce(raw)
        self.byte_ids = np.array([spelled_bytes[b] for b in range(256)]) if len(spelled_bytes) == 256 else None
        skip = unused | set(spelled_bytes.values())
        known = {n.replace(MARK, " ").encode(): i for i, n in enumerate(names) if i not in skip and MARK not in n[1:]}
        spelled = list(known)
        self.longest = max(map(len, spelled), default=1)
        data, ends = np.frombuffer(b"".join(spelled), dtype=np.uint8), np.cumsum([len(x) for x in spelled])
        self.hash, self.piece, self.steps = np.zeros(SLOTS, dtype=np.uint64), np.full(SLOTS, -1, dtype=np.int32), 1
        for h, i in zip(span_hashes(data, ends - [len(x) for x in spelled], ends).tolist(), known.values(), strict=True):
            at, steps = h & (SLOTS - 1), 1
            while self.piece[at] >= 0:
                at, steps = (at + 1) & (SLOTS - 1), steps + 1
            self.hash[at], self.piece[at], self.steps = h, i, max(self.steps, steps)

    @classmethod
    def from_sentencepiece(cls, path: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        spelled = {int(names[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        unused = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        scores = [p.get_score(i) for i in range(n)]
        # log-probabilities sum to about one; merge ranks don't
        total = sum(math.exp(min(s, 0.0)) for i, s in enumerate(scores) if i not in unused and not p.is_byte(i))
        return cls(names, scores, spelled, unused, 0.5 < total < 1.5)

    def fitted(self, expected: np.ndarray, prior: float = PRIOR) -> Pieces:
        """With expected counts of the pieces (and of the end) added to the prior's."""
        out = object.__new__(Pieces)
        out.__dict__.update(self.__dict__)
        counts = expected + prior * np.exp(self.logp)
        with np.errstate(divide="ignore"):
            out.logp = np.log(counts) - math.log(counts.sum())
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Pieces of hashes; -1 where there is none."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.where(self.hash[at] == h, self.piece[at], -1)
        left = np.flatnonzero((out < 0) & (self.piece[at] >= 0))
        for _ in range(self.steps - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (SLOTS - 1)
            out[left] = np.where(self.hash[at[left]] == h[left], self.piece[at[left]], -1)
            left = left[(out[left] < 0) & (self.piece[at[left]] >= 0)]
        return out

    def batches(self, words: list[bytes]):
        """(numbers of words, their lattice) for words of like length, in bounded memory."""
        lengths = np.array([len(w) + 1 for w in words])
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            if lengths[order[at]] > LONG:
                yield order[at : at + 1], LongLattice(self, words[order[at]])
                at += 1
                continue
            n = max(1, min(2048, len(order) - at))
            while n > 1 and ((t := int(lengths[order[at + n - 1]])) > LONG or n * t * min(t, self.longest) > GRID):
                n //= 2
            yield order[at : at + n], Lattice(self, [words[i] for i in order[at : at + n]])
            at += n

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' marginal probabilities over all segmentations."""
        out = np.empty(len(words))
        for numbers, lattice in self.batches(words):
            out[numbers] = lattice.totals()
        return out

    def add_expected(self, words: list[bytes], c: np.ndarray, expected: np.ndarray, n_words: int = 0, novel: float = 1.0) -> None:
        """Expected counts of pieces in words' ``c`` occurrences among ``n_words``; with a mass of the pieces (``novel``) under 1,
        each occurrence is held against the whole-word arc of the others."""
        for numbers, lattice in self.batches(words):
            times = c[numbers].astype(np.float64)
            if novel < 1:
                with np.errstate(divide="ignore"):
                    whole = np.log((1 - novel) * (times - 1) / n_words)
                times = times * np.exp(-np.logaddexp(0, whole - math.log(novel) - lattice.totals()))
            lattice.add_expected(times, expected)


class Lattice:
    """Arcs of several words: ``ids`` and ``weights`` by word, first byte and length less one."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(w) + 1 for w in words])
        self.top = int(self.lengths.max())
        self.reach = min(self.top, pieces.longest)
        grid = np.full((len(words), self.top + self.reach), 32, dtype=np.uint8)
        inside = np.arange(self.top) < self.lengths[:, None]
        grid[:, : self.top][inside] = np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8)
        self.grid, flat = grid, grid.reshape(-1)
        at = (np.arange(len(words)) * grid.shape[1])[:, None] + np.arange(self.top)
        self.ids = np.full((len(words), self.top, self.reach), -1, dtype=np.int32)
        prefix = prefix_sums(flat)
        for k in range(1, self.reach + 1):
            fits = np.arange(self.top) + k <= self.lengths[:, None]
            start = at[fits]
            self.ids[:, :, k - 1][fits] = pieces.find(span_hashes(flat, start, start + k, prefix))
        self.weights = np.where(self.ids >= 0, pieces.logp[self.ids], -np.inf)
        # a character that is no piece has one arc, its byte pieces'
        lead = grid[:, : self.top]
        begins, width = characters(lead, self.lengths[:, None] - np.arange(self.top))
        begins &= inside
        rows, firsts = np.nonzero(begins & (np.take_along_axis(self.ids, np.minimum(width, self.reach)[:, :, None] - 1, axis=2)[:, :, 0] < 0))
        self.bytewise = []
        for r, f in zip(rows.tolist(), firsts.tolist(), strict=True):
            w = min(int(width[r, f]), self.reach)
            spelled = pieces.byte_ids[grid[r, f : f + w]] if pieces.byte_ids is not None else np.zeros(0, dtype=np.int64)
            self.weights[r, f, w - 1] = pieces.logp[spelled].sum() if len(spelled) else FLOOR
            self.bytewise.append((r, f, w, spelled))
        self.alpha: np.ndarray | None = None

    def forward(self) -> np.ndarray:
        """By word and end: the logarithm of the summed weight of all ways to get there."""
        if self.alpha is None:
            alpha = np.full((len(self.lengths), self.top + 1), -np.inf)
            alpha[:, 0] = 0
            k = np.arange(self.reach)
            for j in range(1, self.top + 1):
                n = min(j, self.reach)
                alpha[:, j] = log_sum(alpha[:, j - 1 - k[:n]] + self.weights[:, j - 1 - k[:n], k[:n]])
            self.alpha = alpha
        return self.alpha

    def totals(self) -> np.ndarray:
        return self.forward()[np.arange(len(self.lengths)), self.lengths]

    def add_expected(self, times: np.ndarray, expected: np.ndarray) -> None:
        """Adds ``times`` the posterior of every arc to the counts of its piece."""
        alpha, total, rows = self.forward(), self.totals(), np.arange(len(self.lengths))
        beta = np.full((len(rows), self.top + self.reach + 1), -np.inf)
        beta[rows, self.lengths] = 0
        for t in range(self.top - 1, -1, -1):
            here = t < self.lengths
            beta[here, t] = log_sum(self.weights[here, t] + beta[here, t + 1 : t + 1 + self.reach])
        r, t, k = np.nonzero(self.ids >= 0)
        share = np.exp(np.minimum(0, alpha[r, t] + self.weights[r, t, k] + beta[r, t + k + 1] - total[r])) * times[r]
        expected += np.bincount(self.ids[r, t, k], weights=share, minlength=len(expected))
        for r, t, w, spelled in self.bytewise:
            np.add.at(expected, spelled, np.exp(min(0.0, alpha[r, t] + self.weights[r, t, w - 1] + beta[r, t + w] - total[r])) * times[r])


class LongLattice:
    """The lattice of one long word. Its arcs are found range by range, as often as they are needed."""

    def __init__(self, pieces: Pieces, word: bytes):
        self.pieces, self.data = pieces, np.frombuffer(b" " + word, dtype=np.uint8)
        self.alpha: np.ndarray | None = None

    def arcs(self, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, piece, weight) of the arcs that begin in [a, a + RANGE), by first byte; the arc of a character that
        its bytes spell has piece -1."""
        p, n = self.pieces, len(self.data)
        b = min(a + RANGE, n)
        part = self.data[a : min(b + p.longest, n)]
        prefix, first = prefix_sums(part), np.arange(b - a)
        starts, ends, ids = [], [], []
        found = np.full((b - a, 4), -1, dtype=np.int64)
        for k in range(1, p.longest + 1):
            s = first[first + k <= len(part)]
            i = p.find(span_hashes(part, s, s + k, prefix))
            if k <= 4:
                found[: len(s), k - 1] = i
            has = i >= 0
            starts.append(s[has])
            ends.append(s[has] + k)
            ids.append(i[has])
        begins, width = characters(part[: b - a], n - a - first)
        width = np.minimum(width, p.longest)
        alone = first[begins & (found[first, np.minimum(width, 4) - 1] < 0)]
        starts.append(alone)
        ends.append(alone + width[alone])
        ids.append(np.full(len(alone), -1))
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids).astype(np.int64)
        weight = np.where(piece >= 0, p.logp[piece], FLOOR)
        if p.byte_ids is not None and len(alone):
            sums = np.concatenate(([0.0], np.cumsum(p.logp[p.byte_ids[part]])))
            at = slice(len(start) - len(alone), None)
            weight[at] = sums[end[at]] - sums[start[at]]
        order = np.argsort(start, kind="stable")
        return start[order] + a, end[order] + a, piece[order], weight[order]

    def forward(self) -> np.ndarray:
        if self.alpha is None:
            alpha = array("d", [-math.inf]) * (len(self.data) + 1)
            alpha[0] = 0.0
            for a in range(0, len(self.data), RANGE):
                start, end, _, weight = self.arcs(a)
                for s, e, w in zip(start.tolist(), end.tolist(), weight.tolist(), strict=True):
                    alpha[e] = log_add(alpha[e], alpha[s] + w)
            self.alpha = np.frombuffer(alpha, dtype=np.float64)
        return self.alpha

    def totals(self) -> np.ndarray:
        return self.forward()[-1:]

    def add_expected(self, times: np.ndarray, expected: np.ndarray) -> None:
        alpha, p = self.forward(), self.pieces
        beta = array("d", [-math.inf]) * (len(self.data) + 1)
        beta[len(self.data)] = 0.0
        for a in range((len(self.data) - 1) // RANGE * RANGE, -1, -RANGE):
            start, end, piece, weight = self.arcs(a)
            for s, e, w in zip(start[::-1].tolist(), end[::-1].tolist(), weight[::-1].tolist(), strict=True):
                beta[s] = log_add(beta[s], beta[e] + w)
            b = np.frombuffer(beta, dtype=np.float64)
            share = np.exp(np.minimum(0, alpha[start] + weight + b[end] - alpha[-1])) * times[0]
            own = piece >= 0
            expected += np.bincount(piece[own], weights=share[own], minlength=len(expected))
            if p.byte_ids is not None:
                for s, e, x in zip(start[~own].tolist(), end[~own].tolist(), share[~own].tolist(), strict=True):
                    np.add.at(expected, p.byte_ids[self.data[s:e]], x)
            del b


def characters(lead: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters begin, and how many bytes each has, no more than are left; broken ones have one."""
    width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    begins = (lead & 0xC0) != 0x80
    return begins, np.where(begins, np.maximum(1, np.minimum(width, left)), 1)


def log_add(x: float, y: float) -> float:
    """log of the sum of two exponentials."""
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the last axis."""
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[:, None]).sum(axis=1))


def split_words(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, number of each word among the distinct ones, the distinct words as bytes); A-Z in lower case."""
    low = pc.ascii_lower(pc.fill_null(column(batch, text), ""))
    # white space goes at both ends first, so that no empty words come of it
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(low))
    words = split.values.dictionary_encode()
    counts = np.where(pc.equal(pc.ascii_trim_whitespace(low), "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy())
    at, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast(pa.binary())
    lengths = pc.list_value_length(split).to_numpy()
    if (counts != lengths).any():  # a text without words has one, the empty one
        at = at[np.repeat(counts == lengths, lengths)]
    return counts.astype(np.int64), at.astype(np.int64), names


def summed(tables: list[pa.Table]) -> pa.Table:
    """Counts of words, added up."""
    out = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum"), ("all", "sum")])
    return out.select(["word", "c_sum", "all_sum"]).rename_columns(["word", "c", "all"])


def word_counts(docs: DataFrame, text: str, train: str) -> DataFrame:
    """(word, c, all): occurrences in training documents and in all; words are lower-cased UTF-8."""

    def counted(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in slices(batches, text, rows=1 << 16):
            n, at, names = split_words(batch, text)
            every = np.bincount(at, minlength=len(names))
            own = np.bincount(at[np.repeat(column(batch, train).to_numpy(zero_copy_only=False), n)], minlength=len(names))
            seen = np.flatnonzero(every)
            held.append(pa.table({"word": names.take(pa.array(seen)), "c": pa.array(own[seen], pa.int64()), "all": pa.array(every[seen], pa.int64())}))
            rows += len(seen)
            if rows > 2 * FLUSH:
                held = [summed(held)]
                rows = held[0].num_rows
                if rows > FLUSH:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from summed(held).to_batches()

    return docs.select(text, train).mapInArrow(counted, "word binary, c long, all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("all").alias("all"))


def marginals(pieces: Pieces, words: list[bytes], c: np.ndarray, n: int, novel: float) -> np.ndarray:
    """log10 of words' probabilities: all segmentations into pieces and, with a mass of the pieces under 1, the whole-word arc."""
    by_pieces = math.log(novel) + pieces.log_probabilities(words)
    if novel < 1:
        with np.errstate(divide="ignore"):
            by_pieces = np.logaddexp(by_pieces, np.log((1 - novel) * c / n))
    return by_pieces / math.log(10)


def spread(words: DataFrame, n: int) -> DataFrame:
    """A few seconds of lattice work a task."""
    return words.repartition(max(8, n // WORDS_PER_TASK + 1))


def expected_counts(words: DataFrame, pieces: Pieces, n: int, novel: float) -> np.ndarray:
    """Expected counts of all pieces in the training occurrences of all words; a vector of the vocabulary's size per task is what travels."""
    sent = words.sparkSession.sparkContext.broadcast(pieces)
    schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])

    def added(batches):
        expected = np.zeros(len(sent.value.logp))
        for batch in batches:
            sent.value.add_expected(values(batch, "word"), column(batch, "c").to_numpy(), expected, n, novel)
        at = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(expected[at])], schema=schema)

    out = np.zeros(len(pieces.logp))
    for piece, k in words.mapInArrow(added, "piece int, n double").groupBy("piece").agg(F.sum("n")).collect():
        out[piece] = k
    return out


def score_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, fit_steps: int = 2, word_arcs: bool = False) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score per document (logarithms to base 10)."""
    spark = docs.sparkSession
    ensure_importable(spark)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.expr(f"{crc_remainder_sql(id_col, modulus)} <> 0").alias("__train"))
    kind = source.schema["__id"].dataType
    counts = materialize(word_counts(source, "__text", "__train"), "words")
    ends, all_docs = source.select(F.coalesce(F.sum(F.col("__train").cast("long")), F.lit(0)), F.count("*")).first()
    types, known, once, words_in, all_in = counts.select(F.count("*"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    n, v, tokens = words_in + ends, known + (ends > 0), all_in + all_docs
    floor = n + 0.1 * (v + 1)
    novel = min(0.5, (once + 1) / (n + 1)) if n and word_arcs else 1.0  # the pieces' mass

    pieces = Pieces.from_sentencepiece(vocabulary_path)
    for _ in range(fit_steps if n else 0):
        expected = expected_counts(spread(counts.where("c > 0").select("word", "c"), known), pieces, n, novel)
        if not word_arcs:
            expected[pieces.end] += ends
        pieces = pieces.fitted(expected)
    sent = spark.sparkContext.broadcast(pieces)

    schema = pa.schema([("word", pa.binary()), ("known", pa.int32()), ("base", pa.float64()), ("model", pa.float64()), ("all", pa.int64())])

    def priced(batches):
        for batch in batches:
            c = column(batch, "c").to_numpy()
            yield pa.RecordBatch.from_arrays([column(batch, "word"), pa.array((c > 0).astype(np.int32)), pa.array(np.log10((c + 0.1) / floor)), pa.array(marginals(sent.value, values(batch, "word"), c, n, novel)), column(batch, "all")], schema=schema)

    prices = materialize(spread(counts, types).mapInArrow(priced, "word binary, known int, base double, model double, all long"), "prices")
    release(counts)
    hot = {bytes(r[0]): (r[1], r[2], r[3]) for r in prices.where(F.col("all") * HOT >= tokens).select("word", "known", "base", "model").collect()}  # at most HOT words
    hot_sent = spark.sparkContext.broadcast(hot)
    by_pieces = novel * math.exp(pieces.logp[pieces.end])
    end = int(ends > 0), math.log10((ends + 0.1) / floor), math.log10(by_pieces + ((1 - novel) * ends / n if n else 0.0))

    posting = pa.schema([("row", pa.int64()), ("__id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def split(batches):
        """Per document one row with the sums over frequent words and the end, and one per other word, with null elsewhere."""
        frequent, number = hot_sent.value, TaskContext.get().partitionId() << 40
        for batch in slices(batches, "__text", rows=4096, size=2 << 20):
            docs_here = batch.num_rows
            n_words, at, names = split_words(batch, "__text")
            # the words of each document and how often it has them
            pairs, times = np.unique(np.repeat(np.arange(docs_here), n_words) * max(1, len(names)) + at, return_counts=True)
            doc, word = pairs // max(1, len(names)), pairs % max(1, len(names))
            price = [frequent.get(w) for w in byte_list(names)]
            is_hot = np.array([p is not None for p in price], dtype=bool)
            table = np.array([p or (0, 0.0, 0.0) for p in price], dtype=np.float64).reshape(-1, 3)
            hot_here = is_hot[word]
            sums = [np.bincount(doc[hot_here], weights=times[hot_here] * table[word[hot_here], k], minlength=docs_here) + end[k] for k in range(3)]
            rows = np.arange(number + 1, number + 1 + docs_here)
            number += docs_here
            doc, word, times = doc[~hot_here], word[~hot_here], times[~hot_here]
            of = np.concatenate((np.arange(docs_here), doc))
            nothing = lambda k: np.zeros(k, dtype=np.int64)
            none = len(doc)
            own = pa.array([b" %d" % r for r in rows.tolist()], pa.binary())  # no word has a space
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[of]), column(batch, "__id").take(pa.array(of)), pa.array(~column(batch, "__train").to_numpy(zero_copy_only=False)[of]), pa.concat_arrays([own, names.take(pa.array(word))]),
                    pa.array(np.concatenate((nothing(docs_here), times))), pa.array(np.concatenate((n_words + 1, nothing(none)))), pa.array(np.concatenate((sums[0].astype(np.int64), nothing(none)))),
                    pa.array(np.concatenate((sums[1], np.zeros(none)))), pa.array(np.concatenate((sums[2], np.zeros(none)))),
                ], schema=posting,
            )

    rows = source.mapInArrow(split, f"row long, __id {kind.simpleString()}, held_out boolean, word binary, times long, n_tokens long, n_known long, base_score double, score double")
    # One pass over the texts: a second one might number the rows of a shuffled input differently. Both sides are dealt by
    # word over as many partitions as keep the words of one in memory, so neither is sorted.
    parts = max(8, types // WORDS_PER_JOIN + 1)
    rare = prices.where(F.col("all") * HOT < tokens).drop("all").repartition(parts, "word")
    joined = rows.repartition(parts, "word").join(rare.hint("shuffle_hash"), "word", "left")
    more = lambda own, price: F.sum(F.col(own) + F.col("times") * F.coalesce(price, F.lit(0))).alias(own)
    out = joined.groupBy("row", "__id", "held_out").agg(F.sum("n_tokens").alias("n_tokens"), more("n_known", "known"), more("base_score", "base"), more("score", "model"))
    return out.select(F.col("__id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
