import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphspark.llm import best_fit
from tests.llm.fixtures import docs, nothing, rows, text_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected_ids(text):
    t = tokenizer()
    return np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_packer_is_bounded_best_fit(lengths, open_bins):
    packer = best_fit.BestFit(64, open_bins)
    free, opened = {}, []  # by brute force: the open bins and their free space
    for n in lengths:
        fits = [b for b in opened if free[b] >= n]
        chosen, offset = packer.place(n)
        if fits:
            assert free[chosen] == min(free[b] for b in fits)
        else:
            if len(opened) >= open_bins:
                least = min(free[b] for b in opened)
                closed = packer.closed[-1][0]
                assert free[closed] == least
                opened.remove(closed)
            assert chosen not in free
            free[chosen] = 64
            opened.append(chosen)
        assert offset == 64 - free[chosen]
        free[chosen] -= n
        if not free[chosen]:
            opened.remove(chosen)
        assert len(opened) <= open_bins
    assert sorted(b for b, _ in packer.left()) == sorted(b for b, f in free.items() if f)


def check_layout(out, capacity):
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_whole_query_on_odd_rows(spark):
    out = best_fit.pack_documents(docs(spark), PATH).collect()
    want = []
    for row in rows():
        ids = expected_ids(text_of(row))
        want += [(row[0], p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=key) == sorted(want, key=key)
    total = sum(r.length for r in out)
    assert check_layout(out, 2048) <= -(-total // 2048) + 1


def test_partitions_cost_no_sequences(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([(i, "a " * rng.randint(0, 900)) for i in range(400)], "doc_id long, text string").repartition(40)
    out = best_fit.pack_documents(table, PATH, capacity=512).collect()
    assert check_layout(out, 512) <= -(-sum(r.length for r in out) // 512) + 4


def test_empty_table(spark):
    assert best_fit.pack_documents(nothing(spark), PATH).count() == 0


ODD = ["<|endoftext|> x", "x <|endoftext|>y", "<|ENDOFTEXT|> a <|StartOfText|>", "", " ", "don't stop now then", "don't,, it's!' 'tis x's", "e\u0301 E\u0301 É=\u0338 a<\u0338", "a\x1cb", "ΑΣ Σ", "abc12,3!! ??", "x" * 300 + "," * 90, "straße, İstanbul. ǆ.", "word\u00a0joined,\u3000x"]


def own_ids(encode, texts):
    got = encode(pa.array(texts))
    want = np.concatenate([np.append(expected_ids(t)[:-1], np.uint32(best_fit.WordIds.END_ID)) for t in texts])
    return np.array_equal(got, want)


@pytest.mark.parametrize("text", ODD)
def test_ids_by_words_are_the_tokenizers_ids(text):
    assert own_ids(best_fit.WordIds(PATH), [text])


def test_many_texts_and_a_small_table(monkeypatch):
    monkeypatch.setattr(best_fit, "CACHED_WORDS", 20)
    own, rng = best_fit.WordIds(PATH), random.Random(8)
    words = "The quick, brown FOX's jumps; over (the) lazy dog. Été élan, naïve!! 3rd 42 a-b c/d e.g. x".split()
    for _ in range(30):
        texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "...", "'s", "7"]) for _ in range(rng.randrange(12))) for _ in range(8)]
        texts.insert(rng.randrange(8), rng.choice(ODD))
        assert own_ids(own, texts)


@given(st.lists(st.text(alphabet="ab é'!,1<|>\n\u0338\u0301", max_size=40), min_size=1, max_size=6))
def test_any_texts(texts):
    assert own_ids(best_fit._word_ids(PATH), texts)
