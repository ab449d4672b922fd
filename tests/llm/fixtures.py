"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and to in is that for it on with as was at by this have from or an they which one you".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, prefix long, `row` long, fp long, bin long, word string"


def sentences(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n))


def rows() -> list[tuple]:
    texts = [sentences(60 + 7 * i, i) for i in range(20)]
    texts += [texts[0], texts[0], texts[1] + " end", None, "", "   \n\t ", "word", "élan vital à Zürich", "日本語テスト " * 40, "x" * 30_000, sentences(9_000, 99), "a\x1cb\x85c \U0001f600", "a b c d " * 50, "!!! ???"]
    out = [(i, t, ["en", "fr", None][i % 3], "s", None, 0.5, 1, 2, 3, 4, "w") for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, "a null id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(row) -> str:
    return row[1] or ""
