import math
import tracemalloc
import zlib

import numpy as np
import pytest

from graphspark.llm import langid, quality, toxicity
from graphspark.llm._training import cross_entropy, labelled_sample
from tests.llm.fixtures import docs, nothing, rows, sentences

SF = "/root/testdata/sf0.01"


def held(i, modulus=5):
    return zlib.crc32(str(i).encode()) % modulus


def noisy(n, seed):
    return " ".join(w.upper() + "!!" if i % 2 else w + "$$$" for i, w in enumerate(sentences(n, seed).split()))


def small(spark):
    """Clean, noisy and toxic texts with labels."""
    table, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = noisy(80, i) if bad else sentences(80, i)
        if toxic:
            words = text.split()
            for k in (5, 20, 41, 63):
                words[k] = ("blorgest", "zwackish", "blorging")[k % 3]
            text = " ".join(words)
        table.append((i, text, "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(1, 1, 0), (None, 1, 1), (999, 0, 1), (7, None, None)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    d, l = small(spark)  # noqa: E741
    out = quality.classify_quality(d, l).collect()
    assert all(r.held_out == (held(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in out if r.held_out]) > 0.95


def test_toxicity_held_out(spark):
    d, l = small(spark)  # noqa: E741
    out = toxicity.classify_toxicity(d, l).collect()
    assert all(r.held_out == (held(r.doc_id) == 0) and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in out if r.held_out]) > 0.9


def test_labels_of_held_out_rows_are_not_read(spark):
    d, l = small(spark)  # noqa: E741
    turned = l.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - quality else quality end quality", "toxic")
    a, b = ({r.doc_id: r.score for r in quality.classify_quality(d, x).collect()} for x in (l, turned))
    assert a == b


def test_odd_rows(spark):
    d, l = docs(spark), spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")  # noqa: E741
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        out = f(d, l).collect()
        assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
        assert f(nothing(spark), l).count() == 0
        none = f(d, l.where("doc_id < 0")).collect()
        assert {r.score for r in none} == ({0.5} if f is quality.classify_quality else {0.0})


def plain_pool(text, vectors):
    """The mean vectors of a text's words and shapes, word by word in plain Python."""
    from graphspark.llm._batches import span_hashes

    one = lambda b: int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    total, words, before = np.zeros(2 * quality.DIM), text.split(), None
    for w in words:
        shape = bytearray()
        for c in w:
            k = ord("a") if chr(c).islower() and c < 128 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
            if not shape or shape[-1] != k:
                shape.append(k)
        h = one(bytes(shape)) ^ (0x5851F42D4C957F2D if w == before else 0)
        total += np.concatenate((vectors[0][one(w) % quality.ROWS], vectors[1][h % quality.ROWS]))
        before = w
    return total / max(1, len(words))


def test_quality_score_is_that_of_plain_python():
    texts = [sentences(50, i) if i % 2 else noisy(50, i) for i in range(60)]
    model = quality.Quality([t.encode() for t in texts], np.array([float(i % 2) for i in range(60)]), {0: 30, 1: 90})
    for text in (b"", b" \n", b"a", b"the the THE 12 !!! x9\xc3\xa9", sentences(200, 7).encode(), noisy(30, 1).encode()):
        z = (plain_pool(text, model.vectors) - model.mean) / model.scale
        logit = sum(b * math.tanh(float(z @ model.w["a"][:, k]) + c) for k, (b, c) in enumerate(zip(model.w["b"], model.w["c"], strict=True))) + model.w["d"][0]
        assert model.score([text])[0] == pytest.approx(1 / (1 + math.exp(-logit / model.temperature)), abs=1e-4)


def test_random_indexing_adds_the_vectors_of_near_words():
    texts = [b"a b a c", b"", b"d", b"b b"]
    doc, rows, _ = quality.streams(texts)
    index = quality.index_vectors(11)
    got, want = np.zeros_like(index), np.zeros_like(index)
    quality.add_context(got, doc, rows, index)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if doc[i] == doc[j] and 0 < abs(i - j) <= 2:
                want[rows[i]] += index[rows[j]]
    assert np.allclose(got, want, atol=1e-5)


def plain_gru(xs, wx, u, b):
    k, h, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
    gate = lambda x: 1 / (1 + np.exp(-x))
    for x in xs:
        a = x @ wx + b
        z, r = gate(a[:k] + h @ u[:, :k]), gate(a[k : 2 * k] + h @ u[:, k : 2 * k])
        h = (1 - z) * h + z * np.tanh(a[2 * k :] + (r * h) @ u[:, 2 * k :])
        out.append(h)
    return out


def plain_logit(model, text):
    """The greatest logit of all windows, each by itself, step by step."""
    words, w = toxicity.Words([text]), {k: v.astype(np.float64) for k, v in model.net.w.items()}
    if not words.n:
        return float(w["bias"][0])
    x = model.net.inputs(words.evidence(model.tables), words.word, words.head).astype(np.float64)
    best = -math.inf
    for start in range(0, max(1, words.n - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        xs = x[start : start + toxicity.WINDOW]
        states = [np.concatenate(p) for p in zip(plain_gru(xs, w["xf"], w["uf"], w["bf"]), plain_gru(xs[::-1], w["xb"], w["ub"], w["bb"])[::-1], strict=True)]
        weight = np.exp([np.tanh(s @ w["att"]) @ w["key"] for s in states])
        best = max(best, float(sum(a * s for a, s in zip(weight / weight.sum(), states, strict=True)) @ w["out"] + w["bias"][0]))
    return best


@pytest.fixture(scope="module")
def toxic_model():
    texts = [" ".join("blorgest" if i % 3 == 0 and k in (5, 20) else w for k, w in enumerate(sentences(60, i).split())) for i in range(90)]
    return toxicity.Toxicity([t.encode() for t in texts], np.array([float(i % 3 == 0) for i in range(90)]), {0: 60, 1: 30}, epochs=3)


def test_toxicity_score_is_that_of_plain_python(toxic_model):
    for text in (b"", b"a", b"blorgest", sentences(24, 1).encode(), sentences(25, 2).encode(), sentences(36, 3).encode(), sentences(37, 4).encode(), ("blorgesting " + sentences(100, 3) + " blorgest").encode()):
        want = 1 / (1 + math.exp(-(toxic_model.slope * plain_logit(toxic_model, text) + toxic_model.shift)))
        assert toxic_model.score([text])[0] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("size", [150, 300, 1000])
def test_long_texts_in_ranges(toxic_model, size):
    texts = [sentences(n, n).encode() for n in (30, 200, 241, 700)] + [(sentences(90, 1) + " the the the blorgest\n\n " + sentences(13, 2)).encode()]
    assert np.allclose(toxic_model.score(texts, size), toxic_model.score(texts), atol=1e-5)
    vectors = quality.index_vectors(1), quality.index_vectors(2)
    assert np.allclose(quality.pool(texts, vectors, size), quality.pool(texts, vectors), atol=1e-5)
    assert np.allclose(langid.ngram_features([*texts, b"", "é日".encode() * 300], size), langid.ngram_features([*texts, b"", "é日".encode() * 300]))


def test_memory_of_long_texts(toxic_model):
    text, vectors = (sentences(2_000, 5).encode() + b" ") * 500 + b"x" * 3_000_000, (quality.index_vectors(1), quality.index_vectors(2))
    langs = langid.Languages([b"the cat", b"le chat", b"der hund"] * 9, ["en", "fr", "de"] * 9)
    for f in (lambda: toxic_model.score([text]), lambda: quality.pool([text], vectors), lambda: langs.predict([text])):
        f()
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 120e6, peak


def test_ngrams_are_those_of_plain_python():
    texts = ["Ab cd", "", "é 1x!", "the then"]
    got = langid.ngram_features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        fold = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in b" " + t.encode() + b"    ")
        want = np.zeros(langid.ROWS)
        for at in range(len(t.encode()) + 1):
            for k in (2, 3, 4):
                if 32 not in fold[at + 1 : at + k]:
                    want[(int.from_bytes(fold[at : at + k], "big") * 0x9E3779B97F4A7C15) % (1 << 64) >> 52] += 1
        assert np.allclose(got[i], np.sqrt(want / max(1, want.sum())), atol=1e-6)


def test_decoding_is_that_of_plain_python():
    texts, langs = [], []
    for i in range(60):
        for lang, words in (("a", "the of and to"), ("b", "le la les des"), ("c", "der die das und")):
            texts.append((words + f" {sentences(4, i)}").encode())
            langs.append(lang)
    model = langid.Languages(texts, langs)
    probe = [b"the of and", b"des les la", b"und das", b"the la das", b"x"]
    names, scores, unsure = model.predict(probe)
    for i, t in enumerate(probe):
        margin = langid.ngram_features([t])[0].astype(np.float64) @ model.w + model.b
        loss = [sum(model.weight[k, b] * math.log1p(math.exp(-margin[b] * model.code[k, b])) for b in range(model.code.shape[1])) for k in range(3)]
        order = sorted(range(3), key=loss.__getitem__)
        assert names[i] == model.names[order[0]] and unsure[i] == (loss[order[1]] - loss[order[0]] < langid.AMBIGUOUS)
        assert scores[i] == pytest.approx(1 / sum(math.exp(-(x - min(loss)) * model.code.shape[1]) for x in loss), rel=1e-3)
    assert unsure[4] and not unsure[0]


def test_samples_are_bounded_and_whole(spark):
    long = "start " + "m " * 30_000 + "end"
    d = spark.createDataFrame([(i, long if i % 2 else f"short {i}") for i in range(60)] + [(3, long), (3, "another")], "doc_id long, text string")
    l = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, 1)], "doc_id long, quality int")  # noqa: E741
    texts, y, counts = labelled_sample(d, l, "quality", 10, "true", chars=1600)
    assert counts == {0: 29, 1: 31} and sorted(y.tolist()) == [0.0] * 10 + [1.0] * 10
    for t, label in zip(texts, y, strict=True):
        assert len(t) <= 1615 and (label == 0 or t in ("another", "short 2") or t.startswith("start") and t.endswith("end"))


def test_many_languages_are_all_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 30)
    table = [(i, f"wordof{i % 12}x wordof{i % 12}y " * 20, f"l{i % 12}") for i in range(400)]
    model = langid.fit_languages(spark.createDataFrame(table, "doc_id long, text string, lang string"))
    assert len(model.names) == 12
    # an id that a third of all rows share, and languages whose texts are all long
    hot = spark.createDataFrame([(1, f"le mot numero {i}", "fr") for i in range(300)] + [(i, "word " * 9000, "en") for i in range(20)], "doc_id long, text string, lang string")
    assert langid.fit_languages(hot, per_lang=10, chars=800).names == ["en", "fr"]


def test_ties_and_repeats(spark):
    d, l = small(spark)  # noqa: E741
    twice = d.union(d.where("doc_id < 30")).union(d.where("doc_id = 3").selectExpr("500 doc_id", "text", "lang", "source"))
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        out = f(twice, l).collect()
        assert len(out) == 271
        by_id = {}
        for r in out:
            assert by_id.setdefault(r.doc_id, r.score) == pytest.approx(r.score, abs=1e-6)
        assert by_id[500] == pytest.approx(by_id[3], abs=1e-6)


def test_windows_overlap_and_cover_everything():
    texts = [b"", b"a", b"a " * 24, b"a " * 25, b"a " * 300, b" "]
    words = toxicity.Words(texts)
    doc, start, length = words.windows()
    first = np.cumsum(words.counts) - words.counts
    for i, n in enumerate(words.counts):
        mine = doc == i
        covered = set()
        for s, k in zip(start[mine] - first[i], length[mine], strict=True):
            covered |= set(range(s, s + k))
            assert k <= toxicity.WINDOW
        assert covered == set(range(n))
        assert (np.diff(start[mine]) == toxicity.STEP).all()


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    evidence, word, head = rng.normal(size=(40, 5)), rng.integers(0, 9999, 40), rng.integers(0, 999, 40)
    start, length, y = np.array([0, 10, 20, 30]), np.array([24, 8, 15, 10]), np.array([1.0, 0, 1, 0])
    g = net.gradients(net.inputs(evidence, word, head), word, head, start, length, y)
    loss = lambda: cross_entropy(net.forward(net.inputs(evidence, word, head), start, length).astype(float), y, np.ones(4))
    for k in g:
        at = {"words": (word[3] % toxicity.EMBED_ROWS, 0), "heads": (head[3], 0)}.get(k, (0,) * g[k].ndim)
        own = net.w[k][at]
        net.w[k][at] = own + 1e-2
        above = loss()
        net.w[k][at] = own - 1e-2
        below = loss()
        net.w[k][at] = own
        assert g[k][at] == pytest.approx((above - below) / 2e-2, rel=1e-2, abs=1e-7)  # states are float32


def test_codes():
    for k in (2, 3, 4, 7, 12, 40):
        code = langid.code_matrix(k)
        apart = (code.shape[1] - code @ code.T) / 2
        assert (apart + np.eye(k) * 99).min() >= (1 if k == 2 else code.shape[1] / 4)


def test_languages_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (held(r.doc_id, 4) == 2) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in out if r.held_out]) > 0.98


def test_languages_of_odd_rows(spark):
    out = langid.identify_languages(docs(spark)).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (23, 24, 25, 33)) and by_id[28].lang_pred in ("en", "fr")
    assert langid.identify_languages(nothing(spark)).count() == 0
    one = langid.identify_languages(spark.createDataFrame([(1, "abc", None), (2, "1 2", None)], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in one} == {"und"}
