import pytest

TEXTS = "doc_id long, text string, source string, node long, key string"


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text[, source]) with two more columns whose names operators use inside."""
    def make(rows):
        full = [(*r, "s") if len(r) == 2 else tuple(r) for r in rows]
        return spark.createDataFrame([(*r, 1, "k") for r in full], TEXTS)
    return make


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"),
        (None, "one two three four five six"), (6, "word " * 30_000), (7, "x" * 200_000)]


@pytest.fixture
def edge_rows():
    """Null, empty, blank, repeated, unnamed and very long texts."""
    return list(EDGE)
