import random

import pytest

DOCS = "doc_id long, text string, source string, pack int, _id string, digest string, epoch string, words int"


def rows(pairs):
    """(id, text) with columns whose names the operators use themselves."""
    return [(i, t, "s", 7, "x", "d", "e", 1) for i, t in pairs]


def prose(seed: int, n: int) -> str:
    """Words from a large vocabulary, without repeated stretches."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))


EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "two words"), (None, "no id here at all"), (None, None),
    (7, prose(7, 20_000)), (8, prose(8, 60)), (9, prose(8, 60)), (10, "É à ñ ß 日本 \U0001F600 #|<> MIT License"), (11, "\n".join(["same line here"] * 12)),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(rows(EDGES), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The documents of the smallest table, with an id that no query of this folder filters by."""
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.collect()}
