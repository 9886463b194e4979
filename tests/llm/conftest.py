import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("aeiounrstlkmdp") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def make(n, seed=0, join=" "):
        own = random.Random(seed)
        return join.join(own.choice(lexicon) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def hard_rows(prose):
    """Nulls in every column, empty, blank, very long and repeated texts, and columns that clash with outputs."""
    long = prose(30_000, 9)
    texts = [None, "", " \t\n", "One", prose(60, 1), prose(60, 1), prose(80, 2) + " " + prose(40, 3), prose(40, 3) + " " + prose(70, 4), long,
             "a" * 3000, "\x0b x \x85 y é ▁ 日本"]
    rows = [(i, t, "en", "s", len(t) if t else None, 0.5, "x") for i, t in enumerate(texts)]
    return rows + [rows[4], (None, prose(60, 1), None, None, None, None, None)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
