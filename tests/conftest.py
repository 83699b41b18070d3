from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quern.session import local_session  # noqa: E402
from quern.sources.term_index import build_index  # noqa: E402

TEXTS = {
    1: "Red apples and green apples.",
    2: "green pears, red plums; RED cherries",
    3: "the apples of the north",
    4: "Ünder blue skies 42 birds fly",
    5: "blue birds and red birds",
    6: "",
}


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture(scope="session")
def documents(spark):
    rows = [*TEXTS.items(), (7, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def index(documents):
    return build_index(documents, buckets=3)


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as sorted tuples in the order of its columns."""
    return lambda df: sorted(tuple(r) for r in df.collect())
