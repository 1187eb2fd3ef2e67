import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def texts():
    """Empty, blank, odd, repeated and long texts."""
    rng = random.Random(5)
    words = "the of river stone cloud 12 3rd Alpha beta. gamma, délta Straße naïve ñandú | # token secret".split()
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    return [
        None, "", " \t\n", "one", "one two", "x\x0by\x0cz", "a  b   c \n d\n\n e", "Same line\nSame line\n\n Same line",
        *prose, prose[3], prose[3], prose[4] + " more", LONG, "é" * 50, "  x   y", "a\n \nb \r\n c",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with nulls in every column, repeated rows and columns whose names operators use inside."""
    rows = [(i if i % 11 else None, t, "en" if i % 5 else None, f"s{i % 4}" if i % 7 else None, i, "r", "k", 1, "w") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, KEY string, size int, _words string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def make(spark):
    """make(texts): documents numbered from 1."""

    def build(texts):
        return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts, 1)], "doc_id long, text string, source string").repartition(2)

    return build
