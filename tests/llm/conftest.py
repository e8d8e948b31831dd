import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sol") for b in ("n", "rt", "la", "ss", "")]


@pytest.fixture(scope="session")
def spark(spark):  # noqa: F811 - the session of the other tests, with this folder's settings
    from lexloom.llm.tables import prepare
    return prepare(spark)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ""]) if rng.random() < 0.2 else "") for _ in range(n))


#: nulls, empty and blank texts, no words, a very long text, repeated rows, equal texts
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One two THREE four five six"), (6, "one two three four five six"),
    (7, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six"), (None, None),
    (8, "word\x1cword x éÉ \U0001f600 end."), (9, "long " * 30_000), (-10, "line\nline\n\nline\nother"),
]
EXTRA = "n long, key string, grp int, score string, n_removed string, ids string, source string, lang string, n_chars long"


def frame(spark, rows, extra: bool = True):
    """(doc_id, text) rows, with columns whose names clash with those the operators use."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(*r, 1, "k", None, "s", "r", "i", None if (r[0] or 0) % 3 == 0 else "host", "xx", None) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, " + EXTRA)
