import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from graphspark.llm import simhash
from tests.llm.fixtures import nothing, rows, sentences, text_of


def brute_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, radius=4):
    """{id: least id reachable} for (id, fingerprint) by comparing all pairs."""
    links = defaultdict(set)
    for i, a in items:
        for j, b in items:
            if (a ^ b).bit_count() <= radius:
                links[i].add(j)
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = i
                    todo += links[j]
    return out


def test_fingerprint():
    for text in ("", " ", "one", "A b C", "one two three four", sentences(500, 5), "the the the the the the"):
        assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_balls_find_all_links_for_every_prefix(radius):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:12]:
        for d in range(radius + 2):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    want = brute_components([(int(f), int(f)) for f in fps], radius)
    for bits, part in ((0, 10**7), (3, 10**7), (2, 2_000)):  # the last is split within a partition
        if radius == 5 and part == 2_000:
            continue
        found = np.concatenate([simhash.links_under(fps, p, bits, radius, part=part) for p in range(1 << bits)])
        got = {int(f): int(f) for f in fps}
        changed = True
        while changed:
            changed = False
            for a, b in found.tolist():
                least = min(got[a], got[b])
                changed |= got[a] != least or got[b] != least
                got[a] = got[b] = least
        assert got == want


@pytest.mark.parametrize("radius", [3, 4])
def test_large_groups_are_dealt(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "ROWS_PER_KEY", 7)
    table = [(i, "one two three four five" if i % 2 else sentences(40 + i, i)) for i in range(80)]
    out = simhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(5), radius=radius).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in table], radius)
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted(want.items())


def test_whole_query(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 50_000)
    table = [(r[0], text_of(r)) for r in rows() if r[0] is not None]
    table += [(100 + i, table[1][1] + " more" * (i % 3)) for i in range(30)]
    df = spark.createDataFrame([(i, t if t else None, "x") for i, t in table], "doc_id long, text string, salt string").repartition(4)
    out = simhash.near_duplicates(df).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in table])
    fps = {i: f"{brute_fingerprint(t):016x}" for i, t in table}
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted((i, fps[i], want[i]) for i, _ in table)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted([(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()], key=str) == sorted([(None, 5), (5, 5), (None, None)], key=str)
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def plain_sketches(text, words, sketches, bits):
    """Short fingerprints by plain integers: the bits of the set of shingle hashes, and of those hashes mixed anew, cut up."""
    w = text.encode().lower().split()
    h = {xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))} if w else set()
    top, flags = (1 << 64) - 1, ""
    for k in range(-(-sketches * bits // 64)):
        mixed = []
        for x in h:
            if k:
                x = (x + k * 0x9E3779B97F4A7C15) & top
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
                x = (x ^ x >> 27) * 0x94D049BB133111EB & top
                x ^= x >> 31
            mixed.append(x)
        flags += "".join("1" if 2 * sum(x >> b & 1 for x in mixed) > len(mixed) else "0" for b in reversed(range(64)))
    return [int(flags[k * bits : (k + 1) * bits], 2) for k in range(sketches)]


def plain_similar(texts, words=5, sketches=12, bits=48, radius=4, similarity=0.8):
    """{number: least number reachable} over texts any of whose sketches are near and all together near enough, by comparing all
    pairs; equal sketches link as they are."""
    fps = [plain_sketches(t, words, sketches, bits) for t in texts]
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = math.floor(sketches * bits * share + math.sqrt(sketches * bits * share * (1 - share)) / 2)
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j in range(i):
                if label[i] != label[j]:
                    apart = [(x ^ y).bit_count() for x, y in zip(a, fps[j], strict=True)]
                    if min(apart) == 0 or (min(apart) <= radius and sum(apart) <= most):
                        label[i] = label[j] = min(label[i], label[j])
                        changed = True
    return dict(enumerate(label))


def test_spanning_forest_has_least_distances():
    rng = np.random.default_rng(5)
    pairs, distance = rng.integers(0, 60, (300, 2)), rng.integers(0, 5, 300)
    got = simhash.spanning_forest(pairs, distance, 60)
    weight = {}
    for (a, b), d in zip(pairs.tolist(), distance.tolist(), strict=True):
        weight[a, b] = min(d, weight.get((a, b), 9))
    for most in range(5):  # the pairs of every distance connect what all pairs up to it do
        def labels(edges):
            of = list(range(60))
            for a, b in edges * 60:
                of[a] = of[b] = min(of[a], of[b])
            return of
        assert labels([(a, b) for a, b in got.tolist() if weight[a, b] <= most]) == labels([e for e, d in weight.items() if d <= most])
    assert len(simhash.spanning_forest(np.zeros((0, 2), dtype=np.int64), np.zeros(0), 3)) == 0


def test_similar_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_PER_KEY", 5)
    monkeypatch.setattr(simhash, "DEALT", 7)
    rng, texts = random.Random(3), []
    for i in range(12):
        base = sentences(150, i).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8, 30):
            copy = list(base)
            for at in rng.sample(range(150), edits):
                copy[at] = f"edit{at}"
            texts.append(" ".join(copy))
    texts += ["", " ", "one word", "one word", *["same text of a large group"] * 20]
    df = spark.createDataFrame([(i, t or None, 1) for i, t in enumerate(texts)], "row long, text string, n int").repartition(4)
    got = {r.row: r.component for r in simhash.similar_documents(df, "row").collect()}
    want = plain_similar(texts)
    assert got == want and len(set(want.values())) > 12
    one = simhash.similar_documents(df, "row", sketches=3, bits=50, radius=3, similarity=0.9)
    assert {r.row: r.component for r in one.collect()} == plain_similar(texts, sketches=3, bits=50, radius=3, similarity=0.9)
    assert simhash.similar_documents(df.limit(0), "row").count() == 0
