import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Line string, sid string, c0 string"


def prose(rng, n, words="the of and to in is that for it was on are as with his they at be this have from or one had by".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named like internal ones."""
    rng = random.Random(4)
    long = prose(rng, 60_000)
    a = prose(rng, 80)
    rows = [
        (1, a, "en", "src1"), (1, a, "en", "src1"), (2, a.upper(), "en", "src2"), (3, a + " end", "en", None),
        (4, None, "en", "src1"), (5, "", None, "src1"), (6, " \t\n ", "en", "src1"), (7, long, "en", "src1"), (8, long + " x", "en", "src1"),
        (None, a, "en", "src1"), (None, None, None, None), (None, prose(rng, 50), "en", "src3"), (9, "one two", "en", "src1"),
        (10, "One  Two", "en", "src1"), (11, prose(rng, 40), None, "src12"), (12, "x" * 100_000, "en", "src12"), (13, "1 2 3", "en", "src1"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "x", "y", "z") for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
