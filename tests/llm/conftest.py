import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from brute import prose  # noqa: E402

@pytest.fixture(scope="session")
def corpus():
    """(id, text) rows: prose, exact and edited copies, shared lines, short,
    empty, null and long texts."""
    rng = random.Random(5)
    rows = [(i, "\n".join(prose(rng, rng.randint(6, 40)) for _ in range(rng.randint(1, 4)))) for i in range(90)]
    for i in range(100, 130):
        rows.append((i, rows[i % 7][1]))
    for i in range(130, 190):
        w = rows[i % 5][1].split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    line = prose(rng, 20)
    rows += [(i, prose(rng, 15) + "\n" + line) for i in range(200, 220)]
    rows += [(300, ""), (301, None), (302, "one two"), (303, "One  TWO"), (304, " \n\t "), (305, prose(rng, 4000)),
             (306, "a a a a a a a a"), (307, "a a a a a a a a a a")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").cache()


#: Rows with nulls in every column, repeats, and columns whose names operators might use.
ODD = "doc_id long, text string, score double, row_ string, n long, id string, rk long, predicted int, moved int"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, "Some words stand here in a row", 1.0, "x", 1, "a", 2, 3, 4), (None, None, None, None, None, None, None, None, None),
            (1, "Some words stand here in a row", 1.0, "x", 1, "a", 2, 3, 4), (None, "Other words stand here in a row", *[None] * 7),
            (2, "", *[None] * 7), (3, None, *[None] * 7), (4, " ", *[None] * 7),
            (5, "mail me at bob@mail.example.com, you idiot\nSome words stand here in a row", *[None] * 7)]
    return spark.createDataFrame(rows, ODD)
