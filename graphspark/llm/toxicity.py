"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input has a word part (log-odds and an embedding of its hash) and a
character part (log-odds of its character 4-grams and 5-grams and an embedding of
its first characters), so forms of a word that training hasn't seen still speak.
The log-odds count in how many toxic and other sample documents a word or gram
occurs; while training, a document's own occurrence is left out of them.

The network reads overlapping windows of WINDOW words, STEP apart. Labels are of
documents, so training takes each document's strongest window so far (and a random
one of each clean document). A document's score is that of its strongest window,
over all windows of its whole text, calibrated on sample documents that the
network hasn't learnt from.

The training sample is bounded (``per_class`` documents a label, and of each no more
than ``chars`` characters, in spans spread over the whole text). A long text is
scored in ranges of RANGE bytes, whose windows are those of the whole text.

Defined results: null text is the empty text; a text without words has the score of
the network's bias; with one label only the score is that label, without any it is
0; rows that repeat are scored each on its own; equal texts have equal scores; an id
with several labels has the greatest; a null id is never learnt from; in a text of
over RANGE bytes a run of over 4,096 bytes without white space counts as several
words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from graphspark.llm._batches import SPACES, WordRuns, broken, crc_remainder_sql, ranges
from graphspark.llm._training import SAMPLE_CHARS, Adam, blocks, labelled_sample, sigmoid
from graphspark.llm.quality import FOLDS, score_documents

WINDOW, STEP = 24, 12
HIDDEN, EMBED, ATTEND = 8, 4, 8
WORD_ROWS, GRAM_ROWS, EMBED_ROWS = 1 << 20, 1 << 18, 1 << 12
PER_CLASS = 900
EPOCHS, STEPS = 12, 30
INPUT = 5 + 2 * EMBED
#: Bytes of a text whose words are looked at together.
RANGE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACES] = 32


class Words:
    """Hashed rows of the words of several texts and of their character grams."""

    def __init__(self, texts: list[bytes]):
        runs = WordRuns(texts)
        self.n_docs, self.doc, self.n, self.start = len(texts), runs.doc, len(runs.start), runs.start
        self.counts = runs.counts()
        if not self.n:
            return
        low = np.concatenate((np.array([32], dtype=np.uint8), _LOWER[runs.data]))
        self.word = (runs.hashes(low[1:]) % np.uint64(WORD_ROWS)).astype(np.int64)
        start, end = runs.start, runs.end + 1  # from the space before a word; ``low`` is one byte longer
        lengths = end - start
        self.first = np.cumsum(lengths) - lengths
        self.lengths = lengths
        at = np.repeat(start - self.first, lengths) + np.arange(int(lengths.sum()))
        rest = np.repeat(end, lengths) - at
        wide = np.concatenate((low, np.full(8, 32, dtype=np.uint8))).astype(np.uint64)
        gram = wide[at]
        for k in (1, 2, 3):
            gram = (gram << np.uint64(8)) | wide[at + k]
        mixed = gram * np.uint64(0x9E3779B97F4A7C15)
        self.four, self.has_four = (mixed >> np.uint64(46)).astype(np.int64), rest >= 4
        gram = (gram << np.uint64(8)) | wide[at + 4]
        mixed = gram * np.uint64(0xC2B2AE3D27D4EB4F)
        self.five, self.has_five = (mixed >> np.uint64(46)).astype(np.int64), rest >= 5
        self.gram_doc = np.repeat(self.doc, lengths)
        head = np.zeros(self.n, dtype=np.uint64)  # the space and up to four bytes of the word, nothing of what follows it
        for k in range(5):
            head = (head << np.uint64(8)) | np.where(start + k < end, wide[start + k], np.uint64(32))
        self.head = ((head * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(46)).astype(np.int64) % EMBED_ROWS

    def evidence(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """(words, 5): log-odds of the word, and the most and the mean of its 4-grams' and 5-grams' log-odds."""
        word, four, five = tables
        f, g = four[self.four] * self.has_four, five[self.five] * self.has_five
        out = np.empty((self.n, 5), dtype=np.float32)
        out[:, 0] = word[self.word]
        out[:, 1], out[:, 2] = np.maximum.reduceat(f, self.first), np.add.reduceat(f, self.first) / self.lengths
        out[:, 3], out[:, 4] = np.maximum.reduceat(g, self.first), np.add.reduceat(g, self.first) / self.lengths
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, length) of every window; documents without words have none."""
        n = self.counts
        per = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
        doc = np.repeat(np.arange(self.n_docs), per)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = (np.cumsum(n) - n)[doc] + within * STEP
        return doc, start, np.minimum(WINDOW, n[doc] - within * STEP)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Of documents that hold a word or gram, against all, with two documents of the usual mixture added; 0 where none holds it."""
    share = max(n_toxic, 0.5) / (max(n_toxic, 0.5) + max(n_clean, 0.5))
    out = np.log((toxic + 2 * share) / (clean + 2 * (1 - share))) - np.log(share / (1 - share))
    return (np.clip(np.where(toxic + clean > 0, out, 0), -3, 6) / 3).astype(np.float32)


def gru_step(xw: np.ndarray, h: np.ndarray, u: np.ndarray, mask: np.ndarray | None) -> tuple:
    """One step: gates z and r and candidate c; rows without a word keep their state."""
    k = HIDDEN
    zr = sigmoid_fast(xw[:, : 2 * k] + h @ u[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    c = np.tanh(xw[:, 2 * k :] + (r * h) @ u[:, 2 * k :])
    if mask is not None:
        z = z * mask[:, None]
    return h + z * (c - h), z, r, c


def sigmoid_fast(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """The network's weights, its forward pass and, for training, its gradients."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.w = {
            "words": f(EMBED_ROWS, EMBED, s=0.05), "heads": f(EMBED_ROWS, EMBED, s=0.05),
            "xf": f(INPUT, 3 * HIDDEN), "uf": f(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32),
            "xb": f(INPUT, 3 * HIDDEN), "ub": f(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32),
            "att": f(2 * HIDDEN, ATTEND), "key": f(ATTEND), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, evidence: np.ndarray, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        return np.concatenate((evidence, self.w["words"][word % EMBED_ROWS], self.w["heads"][head]), axis=1)

    def forward(self, x: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows over the rows of ``x``."""
        w = self.w
        n, t_max = len(start), int(length.max(initial=1))
        at = np.minimum(start[:, None] + np.arange(t_max), len(x) - 1)
        mask = (np.arange(t_max) < length[:, None]).astype(np.float32)
        full = bool(mask.all())
        states = np.empty((t_max, n, 2 * HIDDEN), dtype=np.float32)
        kept: dict = {"f": [None] * t_max, "b": [None] * t_max}
        for side, order, part in (("f", range(t_max), slice(0, HIDDEN)), ("b", range(t_max - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            xw, h = x @ w["x" + side] + w["b" + side], np.zeros((n, HIDDEN), dtype=np.float32)
            for t in order:
                new, z, r, c = gru_step(xw[at[:, t]], h, w["u" + side], None if full else mask[:, t])
                if keep:
                    kept[side][t] = (h, z, r, c)
                states[t, :, part] = new
                h = new
        seen = np.tanh(states @ w["att"])
        weight = seen @ w["key"] + (mask.T - 1) * np.float32(1e4)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logits = pooled @ w["out"] + w["bias"]
        return (logits, (at, mask, states, kept, seen, weight, pooled)) if keep else logits

    def gradients(self, x: np.ndarray, word: np.ndarray, head: np.ndarray, start: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of windows' labels."""
        w = self.w
        logits, (at, mask, states, kept, seen, weight, pooled) = self.forward(x, start, length, keep=True)
        t_max = states.shape[0]
        e = ((sigmoid(logits) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ e, "bias": np.array([e.sum()], dtype=np.float32)}
        d_pooled = e[:, None] * w["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnk,nk->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["key"] = np.einsum("tn,tna->a", d_score, seen)
        d_seen = d_score[:, :, None] * w["key"] * (1 - seen * seen)
        g["att"] = np.einsum("tnk,tna->ka", states, d_seen)
        d_states = d_states + d_seen @ w["att"].T
        dx = np.zeros_like(x)
        for side, order, part in (("f", range(t_max - 1, -1, -1), slice(0, HIDDEN)), ("b", range(t_max), slice(HIDDEN, 2 * HIDDEN))):
            u, k = w["u" + side], HIDDEN
            gu, d_xw, d_h = np.zeros_like(u), np.zeros((len(x), 3 * k), dtype=np.float32), np.zeros((states.shape[1], k), dtype=np.float32)
            for t in order:
                h, z, r, c = kept[side][t]
                d = d_h + d_states[t][:, part]
                dz, dc = d * (c - h), d * z
                d_h = d * (1 - z)
                ac = dc * (1 - c * c)
                d_rh = ac @ u[:, 2 * k :].T
                d_h += d_rh * r
                az = dz * z * (1 - z)
                if not mask[:, t].all():
                    az *= mask[:, t][:, None]  # a row without a word has z = 0
                ar = d_rh * h * r * (1 - r)
                gu[:, :k] += h.T @ az
                gu[:, k : 2 * k] += h.T @ ar
                gu[:, 2 * k :] += (r * h).T @ ac
                d_h += az @ u[:, :k].T + ar @ u[:, k : 2 * k].T
                np.add.at(d_xw, at[:, t], np.concatenate((az, ar, ac), axis=1))
            g["u" + side], g["b" + side], g["x" + side] = gu, d_xw.sum(axis=0), x.T @ d_xw
            dx += d_xw @ w["x" + side].T
        g["words"], g["heads"] = np.zeros_like(w["words"]), np.zeros_like(w["heads"])
        np.add.at(g["words"], word % EMBED_ROWS, dx[:, 5 : 5 + EMBED])
        np.add.at(g["heads"], head, dx[:, 5 + EMBED :])
        return g


class Toxicity:
    """The fitted model; ``score`` gives calibrated probabilities of whole texts."""

    def __init__(self, texts: list[bytes], y: np.ndarray, counts: dict, seed: int = 0, epochs: int = EPOCHS):
        self.fitted = len(set(y.tolist())) > 1
        if not self.fitted:
            self.constant = float(y[0]) if len(y) else 0.0
            return
        ranges = blocks(texts)
        seen = [[np.zeros(n, dtype=np.float32) for n in (WORD_ROWS, GRAM_ROWS, GRAM_ROWS)] for _ in range(2)]
        for first, last in ranges:
            p, own = Words(texts[first:last]), y[first:last]
            if not p.n:
                continue
            for k, (doc, row) in enumerate(((p.doc, p.word), (p.gram_doc[p.has_four], p.four[p.has_four]), (p.gram_doc[p.has_five], p.five[p.has_five]))):
                rows = len(seen[0][k])
                once = np.unique(doc * rows + row)
                for label in (0, 1):
                    of = once[own[once // rows] == label] % rows
                    np.add.at(seen[label][k], of, 1)
        n_clean, n_toxic = float((y == 0).sum()), float((y == 1).sum())
        self.tables = tuple(log_odds(t, c, n_toxic, n_clean) for c, t in zip(*seen, strict=True))
        without = [tuple(log_odds(np.maximum(t - label, 0), np.maximum(c - (1 - label), 0), n_toxic - label, n_clean - (1 - label)) for c, t in zip(*seen, strict=True)) for label in (0, 1)]
        evidence, word, head, doc, start, length, base, docs = [], [], [], [], [], [], 0, 0
        for first, last in ranges:
            p, own = Words(texts[first:last]), y[first:last]
            if p.n:
                both = [p.evidence(t) for t in without]
                evidence.append(np.where((own[p.doc] == 1)[:, None], both[1], both[0]))
                word.append(p.word)
                head.append(p.head)
                d, s, n = p.windows()
                doc.append(d + docs)
                start.append(s + base)
                length.append(n)
                base += p.n
            docs += p.n_docs
        self.net = Network(seed)
        if not base:
            self.fitted, self.constant = False, 0.0
            return
        evidence, word, head, doc, start, length = (np.concatenate(v) for v in (evidence, word, head, doc, start, length))
        strength = np.concatenate(([0], np.cumsum(np.maximum(evidence, 0).sum(axis=1, dtype=np.float64))))
        rank = strength[start + length] - strength[start]
        learn = np.arange(len(y)) % 5 != 0
        rng = np.random.default_rng(seed + 1)
        adam = Adam(self.net.w, 0.02)
        firsts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ends = np.append(firsts[1:], len(doc))
        with_words = doc[firsts]
        for epoch in range(epochs):
            if epoch >= 2:
                rank = self._window_logits(evidence, word, head, start, length)
            top = np.array([f + int(np.argmax(rank[f:e])) for f, e in zip(firsts, ends, strict=True)])
            other = firsts + (rng.random(len(firsts)) * (ends - firsts)).astype(np.int64)
            chosen = np.concatenate((top[learn[with_words]], other[learn[with_words] & (y[with_words] == 0)]))
            adam.rate = 0.02 * (1 - epoch / (epochs + 2))
            parts = np.array_split(rng.permutation(chosen), max(1, len(chosen) // 64))
            for part in parts * max(1, STEPS // len(parts)):
                rows = np.unique((start[part][:, None] + np.minimum(np.arange(WINDOW), length[part][:, None] - 1)).reshape(-1))
                x = self.net.inputs(evidence[rows], word[rows], head[rows])
                # windows may share rows, so they are addressed where their first row stands among the kept ones
                adam.step(self.net.gradients(x, word[rows], head[rows], np.searchsorted(rows, start[part]), length[part], y[doc[part]]))
        logits = np.full(len(y), float(self.net.w["bias"][0]))
        window = self._window_logits(evidence, word, head, start, length)
        logits[with_words] = np.maximum.reduceat(window, firsts)
        held = ~learn if len(set(y[~learn].tolist())) > 1 else learn | True
        share = {k: counts[k] / max(1, float((y == k).sum())) for k in set(y.tolist())}
        weight = np.array([share[k] for k in y.tolist()])
        self.slope, self.shift = calibrate(logits[held], y[held], weight[held])

    def _window_logits(self, evidence, word, head, start, length) -> np.ndarray:
        x = self.net.inputs(evidence, word, head)
        out = np.empty(len(start), dtype=np.float32)
        for i in range(0, len(start), 4096):
            lo, hi = start[i], start[i : i + 4096].max() + WINDOW
            out[i : i + 4096] = self.net.forward(x[lo:hi], start[i : i + 4096] - lo, length[i : i + 4096])
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Per text the strongest window's."""
        out = np.full(len(texts), float(self.net.w["bias"][0]))
        words = Words(texts)
        if words.n:
            doc, start, length = words.windows()
            window = self._window_logits(words.evidence(self.tables), words.word, words.head, start, length)
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            out[doc[first]] = np.maximum.reduceat(window, first)
        return out

    def long_logit(self, text: bytes, size: int) -> float:
        """As ``logits`` of one text, range by range: a range begins with a window, and has all full windows but for the last
        word's, as what follows that word isn't seen; the next range begins with the first window that wasn't taken."""
        text = broken(text)
        parts, held, best = list(ranges(text, size)), b"", -np.inf
        for i, (start, end) in enumerate(parts):
            held += text[start:end]
            words = Words([held])
            last = i == len(parts) - 1
            if not words.n or last and i and best > -np.inf and words.n <= WINDOW - STEP:
                break
            _, first, length = words.windows()
            if not last:
                whole = first + WINDOW < words.n
                if not whole.any():
                    continue
                first, length = first[whole], length[whole]
            best = max(best, float(self._window_logits(words.evidence(self.tables), words.word, words.head, first, length).max()))
            if not last:
                held = held[words.start[first[-1] + STEP] :]
        return best if best > -np.inf else float(self.net.w["bias"][0])

    def score(self, texts: list[bytes], size: int | None = None) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        size = size or RANGE
        logits = self.logits([b"" if len(t) > size else t for t in texts])
        for i, t in enumerate(texts):
            if len(t) > size:
                logits[i] = self.long_logit(t, size)
        return sigmoid(self.slope * logits + self.shift)


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over logits, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    weight = weight / weight.mean()
    soft = np.where(y == 1, 1 - 0.5 / (1 + (y == 1).sum()), 0.5 / (1 + (y == 0).sum()))
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)
    for _ in range(50):
        p = sigmoid(a * logits + b)
        g = x.T @ (weight * (p - soft)) + np.array([0.1 * (a - 1), 0.01 * b])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.01])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.05, float(a)), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS) -> Toxicity:
    texts, y, counts = labelled_sample(docs, labels, label_col, per_class, f"{crc_remainder_sql(id_col, FOLDS)} <> 0", id_col, text_col, chars)
    return Toxicity([t.encode() for t in texts], y, counts)


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    return score_documents(docs, fit_toxicity(docs, labels, **options), threshold=threshold)
