import random

import pytest

from tests.llm.brute import ODD_SCHEMA

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(150)]


def prose(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def texts():
    """Null, empty, blank and short texts, copies, near copies, shared passages, and one long text."""
    out = [None, "", " \n\t ", "one", "one", "a b c", "a\tb  c", "Ünï cödé 日本語 🎉 " * 9, "x" * 5000]
    base, passage = prose(120), prose(30)
    out += [" ".join(base)] * 4
    for k in range(12):
        near = list(base)
        for _ in range(k // 2):
            near[random.randrange(len(near))] = random.choice(VOCABULARY)
        out.append(" ".join(near))
    out += [" ".join(prose(40) + passage + prose(random.randint(5, 60))) for _ in range(8)]
    out += ["\n".join(" ".join(prose(9)) for _ in range(12)) for _ in range(6)]
    out.append(" ".join(prose(4000)))
    out.append(" ".join(prose(50) * 3))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """(DataFrame, rows of (doc_id, text)); the first document comes twice, and one row has no id."""
    rows = [(3 * i + 1, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 1, "g", "w", 0, 0.5, "i", "h") for i, t in enumerate(texts())]
    table = spark.createDataFrame([*rows, rows[0], (None, "token = 'abcdefghijklmn' x", *rows[1][2:])], ODD_SCHEMA)
    return table.repartition(3), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
