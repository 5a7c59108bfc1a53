import numpy as np
import pytest

from tidemark.llm.common import tuned

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, tile long, blob string, part int, hits string"


@pytest.fixture(autouse=True)
def wrap():
    """64-bit hashes wrap around on purpose."""
    with np.errstate(over="ignore", divide="ignore"):
        yield


@pytest.fixture
def docs(spark):
    """Documents from {doc_id: text} or pairs, with extra columns of clashing names."""
    tuned(spark)

    def build(rows):
        pairs = rows.items() if isinstance(rows, dict) else rows
        data = [(i, t, "en", "s", 0, 7, 7, "x", 3, "y") for i, t in pairs]
        return spark.createDataFrame(data, SCHEMA)

    return build


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two"), (None, "lost text"),
    (5, "word " * 20_000), (6, "x" * 50_000), (7, "ünïcode 😀 \x00 text\r\n"), (8, "\n\n\n"),
]


@pytest.fixture
def awkward(docs):
    return docs(AWKWARD)


@pytest.fixture
def empty(docs):
    return docs([])
