import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and long texts, ties and repeated rows, clashing column names."""
    rng = random.Random(0)
    long = prose(rng, 30_000)
    base = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "x"), (None, None), (3, ""), (4, "   \n\t "), (5, long), (6, "é ü 日本 \U0001f600"), (7, long)]
    return [(i, t, "en", s, 1, 2.0) for (i, t), s in zip(base, ["s", "s", None, "t", "u", "s", "t", "u", "s", "t"], strict=True)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, size int, score double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
