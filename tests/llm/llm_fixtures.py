"""Fixtures of these tests; not a conftest, whose name the folder above has."""

from __future__ import annotations

import random

import pytest


def prose(seed, n_words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeéüß") for _ in range(draw.randint(1, 7))) for _ in range(n_words))


@pytest.fixture(scope="session")
def texts():
    """Plain, empty, blank, null-free, long, copied and slightly changed texts."""
    base = prose(1, 120)
    return {
        1: base, 2: base, 3: base + " end", 4: prose(2, 3), 5: "", 6: " \t\n", 7: "one", 8: prose(3, 4000),
        9: prose(4, 90) + "\n" + base, 10: "\n".join(["same line here"] * 30), 11: "A B a b A B a b", 12: base.upper(),
    }


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, a null text, a null id, and columns whose names clash with results."""
    rows = [(i, t, "x", i) for i, t in texts.items()] + [(13, None, None, None), (None, "one", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n_words long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id > 1000")
