import random

import pytest

from kinframe.llm.common import ship

WORDS = "alpha beta gamma delta the of and river stone light zwölf été mañana house over under night green".split()


def prose(rng: random.Random, n: int, per_line: int = 12) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", str(rng.randrange(50))]))
        out.append("\n" if k % per_line == per_line - 1 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def session(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, blank and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    shared = prose(rng, 60)
    long = prose(rng, 6000)
    base = prose(rng, 200)
    rows = [(0, base, "a"), (1, None, None), (2, "", "a"), (3, " \n\t ", "b"), (None, "lost id " + prose(rng, 80), "a"),
            (4, base, "a"), (5, base.replace("river", "rivers", 1), "a"), (6, long, "b"), (7, long[:9000], "b"),
            (8, "be " * 400, "c"), (9, "x" * 350, None), (10, "x" * 99, "c"), (11, shared, "a"),
            (12, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30), "a"),
            (13, prose(rng, 40) + " " + shared, "b"), (13, prose(rng, 40) + " " + shared, "b"), (14, "one two", "a"),
            (15, "é" * 120 + "\n" + "é" * 120, "a"), (16, shared.upper(), "a"), (17, "a\x00b\x0bc\x0cd <|endoftext|> It's", "a")]
    rows += [(20 + k, prose(rng, rng.randrange(1, 160)), "a") for k in range(30)]
    rows.append(rows[15])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def odd_docs(session, odd_rows):
    """The rows with extra columns named like ones that operators make."""
    return session.createDataFrame(
        [(i, t, s, None if t is None else len(t), 1, "k", 2.0) for i, t, s in odd_rows],
        "doc_id long, text string, source string, n_chars long, id int, key string, kept double")


@pytest.fixture(scope="session")
def no_docs(session):
    return session.createDataFrame([], "doc_id long, text string, source string, n_chars long")
