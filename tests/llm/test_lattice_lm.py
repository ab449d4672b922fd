import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from graphspark.llm import lattice_lm as lm
from tests.llm.fixtures import docs, nothing, rows, text_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lm.Pieces.from_sentencepiece(PATH)


@pytest.fixture(scope="module")
def names():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {p.id_to_piece(i): i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}, {int(p.id_to_piece(i)[3:5], 16): i for i in range(p.get_piece_size()) if p.is_byte(i)}


def segmentations(word, names):
    """All ways to cut the marked word into pieces, as lists of ids; a character that is no piece is its bytes."""
    known, spelled = names
    found = []

    def go(rest, ids):
        if not rest:
            found.append(ids)
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                go(rest[k:], [*ids, known[rest[:k]]])
        if rest and rest[0] not in known:
            go(rest[1:], [*ids, *(spelled[b] for b in rest[0].encode())])

    go(lm.MARK + word, [])
    return found


@pytest.mark.parametrize("word", ["the", "thlyou", "aneaer", "élan", "a", "\U0001f9ff", "x日\U0001f9ffy", "...!!"])
def test_marginal_sums_all_segmentations(pieces, names, word):
    want = sum(math.exp(sum(pieces.logp[i] for i in ids)) for ids in segmentations(word, names))
    assert pieces.log_probabilities([word.encode()])[0] == pytest.approx(math.log(want), rel=1e-12)


def test_weights_are_a_distribution(pieces):
    assert np.exp(pieces.logp).sum() == pytest.approx(1)


def test_batches_agree_with_single_words(pieces):
    words = [w.encode() for w in ("the", "a", "of", "x" * 300, "über", "", "thlyou", "日本語")]
    together = pieces.log_probabilities(words)
    assert np.allclose(together, [pieces.log_probabilities([w])[0] for w in words])
    assert np.isfinite(pieces.log_probabilities([b"\xff\xfe", b"a" * 20_000])).all()


def test_expected_counts_are_posteriors(pieces, names):
    words, c, novel, n = ["thlyou", "the", "aneaer", "x日"], np.array([1, 50, 2, 1]), 0.1, 54
    got = np.zeros(len(pieces.logp))
    pieces.add_expected([w.encode() for w in words], c, got, n, novel)
    want = np.zeros(len(pieces.logp))
    for word, times in zip(words, c, strict=True):
        cuts = segmentations(word, names)
        weight = np.array([math.exp(sum(pieces.logp[i] for i in ids)) for ids in cuts])
        by_pieces = novel * weight.sum()
        share = times * by_pieces / (by_pieces + (1 - novel) * (times - 1) / n)
        for ids, w in zip(cuts, weight / weight.sum(), strict=True):
            for i in ids:
                want[i] += share * w
    assert np.allclose(got, want)


def test_long_words_in_ranges(pieces, monkeypatch):
    words = [w.encode() for w in ("thlyou" * 9, "x日\U0001f9ffyüber" * 7, "the" + "\U0001f9ff" * 20, "a" * 50)] + [b"\xff\xfeab\xc3" * 12]
    c, want, got = np.array([1, 4, 2, 9, 3]), np.zeros(len(pieces.logp)), np.zeros(len(pieces.logp))
    totals = pieces.log_probabilities(words)
    pieces.add_expected(words, c, want)
    monkeypatch.setattr(lm, "LONG", 8)
    for size in (7, 16, 1000):
        monkeypatch.setattr(lm, "RANGE", size)
        assert np.allclose(pieces.log_probabilities(words), totals, rtol=1e-12)
        got[:] = 0
        pieces.add_expected(words, c, got)
        assert np.allclose(got, want)


def test_memory_of_a_long_word(pieces):
    word = (b"thlyou" * 40_000)[:200_000]
    tracemalloc.start()
    assert math.isfinite(pieces.log_probabilities([word])[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_score_is_that_of_plain_python(spark, pieces, names):
    """The whole query with a fitting step: every segmentation listed, counts and sums in plain Python."""
    texts = [(i, t) for i, t in enumerate(["The cat", "the  a x日", "a", "cat the\nA ab", "", None, "Cat x日 x日", "dog a", "dog", "the dog", "a a a cat", "ab"])]
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in texts}
    words = {i: (t or "").lower().split() for i, t in texts}
    counts = Counter(w for i in words if train[i] for w in words[i])
    expected = np.zeros(len(pieces.logp))
    expected[pieces.end] = sum(train.values())
    weigh = lambda ids, logp: math.exp(sum(logp[k] for k in ids))
    for w, k in counts.items():
        cuts = segmentations(w, names)
        total = sum(weigh(ids, pieces.logp) for ids in cuts)
        for ids in cuts:
            for x in ids:
                expected[x] += k * weigh(ids, pieces.logp) / total
    with np.errstate(divide="ignore"):
        logp = np.log(expected + lm.PRIOR * np.exp(pieces.logp))
    logp -= np.logaddexp.reduce(logp)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for r in lm.score_texts(df, PATH, fit_steps=1).collect():
        want = logp[pieces.end] + sum(math.log(sum(weigh(ids, logp) for ids in segmentations(w, names))) for w in words[r.doc_id])
        assert r.score == pytest.approx(want / math.log(10), rel=1e-9) and r.held_out != train[r.doc_id]


def test_whole_query_on_odd_rows(spark, pieces):
    out = lm.score_texts(docs(spark), PATH).collect()
    counts, held = Counter(), {}
    for row in rows():
        train = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 10 != 0
        held[row[0]] = not train
        if train:
            counts.update(text_of(row).encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    price = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    want = []
    for row in rows():
        tokens = [*text_of(row).encode().lower().split(), "end"]
        want.append((row[0], held[row[0]], len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(map(price, tokens)), 6)))
    key = lambda x: tuple((e is None, e) for e in x)
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out], key=key) == sorted(want, key=key)
    # a text's score is the sum over its words: texts of one word and the end tell what each word costs
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[20] == pytest.approx(by_id[0]) and by_id[24] > by_id[26] and all(math.isfinite(s) for s in by_id.values())
    assert lm.score_texts(nothing(spark), PATH).count() == 0


def test_rare_and_frequent_words_agree(spark, monkeypatch):
    """Sending words to the workers or joining them gives the same scores."""
    a = {(r.doc_id, r.n_tokens): (r.base_score, r.score, r.n_known) for r in lm.score_texts(docs(spark), PATH).collect()}
    monkeypatch.setattr(lm, "HOT", 20)
    monkeypatch.setattr(lm, "WORDS_PER_JOIN", 5)
    monkeypatch.setattr(lm, "FLUSH", 10)
    b = {(r.doc_id, r.n_tokens): (r.base_score, r.score, r.n_known) for r in lm.score_texts(docs(spark), PATH).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_fitting_raises_held_out_probability(spark):
    rng = random.Random(6)  # words that held-out documents don't share with the others
    texts = [(i, " ".join("".join(rng.choice(("th", "er", "on", "an")) for _ in range(9)) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    total = lambda steps: sum(r.score for r in lm.score_texts(df, PATH, fit_steps=steps).collect() if r.held_out)
    assert total(1) > total(0)


def test_words_of_a_batch():
    import pyarrow as pa

    texts = ["", None, " ", "A b  a\n", "é É b", "\x1c x\x0b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    n, at, names = lm.split_words(batch, "t")
    want = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want] and [names[i].as_py() for i in at] == [w for x in want for w in x]


def test_whole_word_arcs_are_an_option(spark):
    df = spark.createDataFrame([(i, "zyxgrmblq common words") for i in range(40)], "doc_id long, text string")
    total = lambda arcs: sum(r.score for r in lm.score_texts(df, PATH, word_arcs=arcs).collect())
    assert total(True) > total(False)
