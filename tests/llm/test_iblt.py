import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphspark.llm import iblt
from tests.llm.fixtures import docs, nothing, rows, sentences, text_of


def sets(d, i):
    return set(d.digest[d.doc == i].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab c\n", max_size=400), st.text(alphabet="ab c\n", max_size=400)), min_size=1, max_size=6))
def test_peeling_recovers_the_difference(pairs):
    a, b = iblt.Digests([x.encode() for x, _ in pairs]), iblt.Digests([y.encode() for _, y in pairs])
    near = iblt.likeness(a, b)
    for i, (only_a, only_b) in enumerate(iblt.differences(a, b)):
        assert set(only_a.tolist()) == sets(a, i) - sets(b, i) and set(only_b.tolist()) == sets(b, i) - sets(a, i)
        union = sets(a, i) | sets(b, i)
        assert near[i] == (len(sets(a, i) & sets(b, i)) / len(union) if union else 1.0)


def test_large_differences_are_retried_larger():
    a, b = iblt.Digests([sentences(20_000, 1).encode()]), iblt.Digests([sentences(20_000, 2).encode()])
    only_a, only_b = iblt.differences(a, b)[0]
    assert set(only_a.tolist()) == sets(a, 0) - sets(b, 0) and len(only_a) > 2_000 and len(only_b) > 2_000


def test_cells_are_words_of_a_line():
    one = iblt.Digests([b"a b c d e f g h i\nj k", b"a b c d e f g h\ni\nj k", b"a b c\na b c"])
    assert one.sizes.tolist() == [3, 3, 2]
    assert sets(one, 0) == sets(one, 1)


def test_equal_digests_end():
    """Cells whose masked digests agree, in one version only, and a check value that lies."""
    a = iblt.Digests.of(np.array([0, 0, 0, 1]), np.array([5, 5 + (1 << 40), 9, 7]), 2)
    b = iblt.Digests.of(np.array([0, 1]), np.array([9, 7]), 2)
    assert a.sizes.tolist() == [2, 1]
    (only_a, only_b), (c, d) = iblt.differences(a, b)
    assert only_a.tolist() == [5] and not len(only_b) and not len(c) and not len(d)


def test_what_cannot_be_peeled_is_told_apart_exactly(monkeypatch):
    monkeypatch.setattr(iblt.Sketches, "peel", lambda s: (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(s.n_docs, bool)))
    a, b = iblt.Digests([b"one\ntwo\nthree", b""]), iblt.Digests([b"two\nfour", b""])
    for i, (only_a, only_b) in enumerate(iblt.differences(a, b)):
        assert set(only_a.tolist()) == sets(a, i) - sets(b, i) and set(only_b.tolist()) == sets(b, i) - sets(a, i)


def test_a_million_lines():
    a, b = iblt.Digests([b"\n".join(b"%d" % i for i in range(1_000_000))]), iblt.Digests([b"x"])
    assert iblt.likeness(a, b)[0] == 0.0 and abs(int(a.sizes[0]) - 1_000_000) < 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=300), min_size=1, max_size=4), st.integers(8, 60))
def test_ranges_give_the_same_cells(texts, size):
    texts = [t.encode() for t in texts]
    want, got = iblt.cell_hashes(texts), iblt.cell_hashes(texts, size)
    for i in range(len(texts)):
        assert got[1][got[0] == i].tolist() == want[1][want[0] == i].tolist()


def test_sketches_subtract():
    a, b = iblt.Digests([b"one line\nanother"]), iblt.Digests([b"one line\na third"])
    sa, sb = iblt.Sketches(1, 24), iblt.Sketches(1, 24)
    sa.add(a.doc, a.digest)
    sb.add(b.doc, b.digest)
    doc, digest, sign, clean = sa.minus(sb).peel()
    assert clean.all() and sorted(sign.tolist()) == [-1, 1] and len(sa.packed()[0]) == 24 * 8


def test_whole_query_on_odd_rows(spark):
    table = [r for r in rows() if r[0] is not None]
    df = spark.createDataFrame([(r[0], r[1], "clash") for r in rows()], "doc_id long, text string, part string").repartition(5)
    out = iblt.fingerprint_documents(df.where("doc_id is not null")).collect()
    order = sorted(sorted(table, key=text_of), key=lambda r: r[0], reverse=True)
    want = []
    for i, r in enumerate(order):
        t, u = text_of(r), text_of(order[(i + 1) % len(order)])
        half = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    by_text = {}
    texts = {r[0]: text_of(r) for r in table}
    for r in out:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out])
    assert iblt.fingerprint_documents(df).count() == len(rows())


def test_one_document_and_none(spark):
    only = iblt.fingerprint_documents(docs(spark).where("doc_id = 3")).collect()
    assert len(only) == 1 and only[0].near_next == 1.0
    assert iblt.fingerprint_documents(nothing(spark)).count() == 0
