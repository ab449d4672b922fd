import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphspark.llm import bpe
from tests.llm.fixtures import docs, nothing, rows, text_of

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text())
def test_same_ids_as_the_library(library, text):
    own = bpe.coder(PATH, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 20_000, "a" * 5_000, "aaaaaaab" * 999, "é" * 999, "".join(random.Random(1).choice("abc") for _ in range(20_000))])
def test_very_long_matches(library, text):
    assert bpe.coder(PATH, public_tokenizers.PATTERN).encode(text) == library.encode_ordinary(text)


def test_queue_gives_lowest_rank_from_the_left():
    queue, rng, items = bpe.RankQueue(), random.Random(2), {}
    for _ in range(3000):
        if rng.random() < 0.7 or not items:
            rank, position = rng.randrange(50_000) % rng.choice((300, 50_000)), rng.randrange(1000)
            items.setdefault(rank, []).append(position)
            queue.push(rank, position)
        else:
            assert queue.pop() == (min(items), sorted(items.pop(min(items))))
    while items:
        assert queue.pop() == (min(items), sorted(items.pop(min(items))))
    assert not queue.top and not queue.buckets


def plain_ids(piece, ranks):
    """The lowest rank, from the left, merged until there is none."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.text(alphabet="abc", min_size=1, max_size=24), min_size=1, max_size=12))
def test_any_ranks_and_shared_queues(seed, pieces):
    """Ranks in any order: a merge may make a pair of lower rank than its own."""
    rng = random.Random(seed)
    spellings = list({"a", "b", "c", *("".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(40))})
    rng.shuffle(spellings)
    ranks = {x.encode(): i for i, x in enumerate(spellings)}
    own = bpe.ByteBpe(ranks, r"[abc]+")
    got = own.encode_texts([" ".join(pieces), pieces[0], ""])
    assert got[0].tolist() == [i for p in pieces for i in plain_ids(p.encode(), ranks)]
    assert got[1].tolist() == plain_ids(pieces[0].encode(), ranks) and not len(got[2])


def test_a_small_table_of_matches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_MATCHES", 30)
    monkeypatch.setattr(bpe, "BATCH", 50)
    own = bpe.ByteBpe.from_lines(open(PATH, "rb"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("thelyouéx9 ") for _ in range(rng.randrange(1, 90))) for _ in range(5)) for _ in range(3)]
        assert [x.tolist() for x in own.encode_texts(texts)] == [library.encode_ordinary(t) for t in texts]


def test_whole_query_on_odd_rows(spark, library):
    out = bpe.encode_documents(docs(spark), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for row in rows():
        ids = library.encode_ordinary(text_of(row))
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(row).encode()).hexdigest()))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([tuple(r)[:4] for r in out], key=key) == sorted(want, key=key)
    assert all(bytes(r.decoded) == library.decode_bytes(r.ids) for r in out)
    assert bpe.encode_documents(nothing(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_decode_column(spark, library):
    df = spark.createDataFrame([(library.encode_ordinary("hello wörld"),), ([],), (None,)], "ids array<int>")
    assert [None if r[1] is None else bytes(r[1]) for r in bpe.decode_ids(df, PATH, public_tokenizers.PATTERN).collect()] == ["hello wörld".encode(), b"", None]
