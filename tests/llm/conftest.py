import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sol", "fan", "gri") for b in ("la", "ne", "pi", "dor", "sum", "vek", "zu", "tha")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def edited(text, every, seed):
    """text with every n-th word replaced."""
    r, words = random.Random(seed), text.split(" ")
    return " ".join(w if i % every else r.choice(WORDS) + "x" for i, w in enumerate(words, 1))


@pytest.fixture()
def docs(spark):
    """Rows (doc_id, text) as documents with extra columns, some named like the operators' own."""

    def make(rows):
        own = spark.createDataFrame(rows, "doc_id long, text string")
        extra = {c: F.lit("x") for c in ("node", "key", "mark", "n", "size", "score", "body", "grp", "spans_", "window", "term")}
        return own.withColumns(extra | {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, "some text here"), (5, "same text"), (5, "same text")]


@pytest.fixture()
def odd():
    """Null and empty texts, a null id, a repeated row, a very long text."""
    return [*ODD, (6, prose(30_000, 6))]
