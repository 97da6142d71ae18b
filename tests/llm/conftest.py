import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd white space, nulls and blanks: (doc_id, text)."""
    draw = random.Random(4)
    base = [prose(draw, draw.randrange(20, 200)) for _ in range(40)]
    rows = list(enumerate(base))
    shared = prose(draw, 60)
    for i in range(12):
        rows.append((100 + i, f"{prose(draw, 30)} {shared}\n{prose(draw, 20)}"))
    near = base[3].split()
    for i in range(25):  # a group of near copies
        copy = list(near)
        for _ in range(i % 5):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(1000)}"
        rows.append((200 + i, " ".join(copy)))
    rows += [(300 + i, base[7]) for i in range(6)]  # exact copies
    rows += [(400, ""), (401, None), (402, "  \n\t "), (403, "one"), (404, "One"), (405, "a b c"), (406, "Ünï cödé   wörds " * 30), (407, "=" * 700), (408, "ab" * 400), (409, "x" * 30_000), (410, prose(draw, 6_000))]
    rows += [(5, prose(draw, 50)), (None, base[9]), (None, prose(draw, 40)), (None, base[9])]  # ids that repeat or lack
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """As a table, with columns whose names operators might use themselves."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k", "'clash' AS row", "2 AS n_words", "0.5 AS score", "3 AS hits")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
