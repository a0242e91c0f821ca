"""Small awkward tables: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, slot int, k string"


def prose(rng, n, words=200):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, words)) for _ in range(n))


def documents():
    rng = random.Random(7)
    texts = [prose(rng, 60) for _ in range(12)]
    base = prose(rng, 200, 5000).split(" ")
    for edits in (0, 1, 2, 4, 8, 16):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10 ** 6)}"
        texts.append(" ".join(w))
    passage = prose(rng, 40, 9000)
    texts += [f"{prose(rng, 20, 9000)} {passage}\n{prose(rng, 20, 9000)}" for _ in range(4)]
    texts += [texts[0], texts[0].upper(), texts[12], "", "  \t\n", None, "one", "one two three", "x " * 30, "same same " * 40, "Über ÜBER é b c " * 10]
    texts.append(prose(rng, 30000, 60000))
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), "a", 0.5, 1, "z") for i, t in enumerate(texts)]
    rows += [rows[2], rows[13], (None, texts[12], None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs_rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
