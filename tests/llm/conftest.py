import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(draw, n, alphabet="abcdefghij", size=(2, 7)):
    return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(*size))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    draw = random.Random(3)
    base = [words(draw, draw.choice([6, 30, 80, 200])) for _ in range(40)]
    shared = words(draw, 60)
    texts = list(base)
    texts += [base[3]] * 4 + [base[5]]
    for k in (7, 8, 9, 9, 9):
        w = base[k].split()
        w[draw.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{base[k][:300]} {shared}\n{base[k + 1][:100]}" for k in range(10, 16)]
    texts += [None, "", " \n\t", "a", "a b c d", "A B c D", "x " * 400, "repeat this line\n" * 60, words(draw, 6000), "é" * 300, "ÄÖ ß " * 50]
    rows = [(k, t, "en" if k % 2 else "de", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows + [rows[0], (None, base[20], None, None, None), (None, "alone without id " * 3, None, None, 1)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "t", "k", "row", "s", "one")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
