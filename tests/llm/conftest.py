import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id int, word string, row long, fingerprint string, block string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    clash = (7, 1, "w", 5, "f", "b")
    rows = [
        (1, "Alpha beta gamma delta", "en", "a", 4, *clash),
        (1, "Alpha beta gamma delta", "en", "a", 4, *clash),
        (2, "ALPHA beta gamma delta", "en", "b", 4, *clash),
        (3, "", "en", "a", 0, *clash),
        (4, None, None, None, None, None, None, None, None, None, None),
        (None, "one two", "de", "b", 3, *clash),
        (None, None, "de", None, 3, *clash),
        (5, " \t\n\x0b ", "fr", "b", 3, *clash),
        (6, "long " * 60_000 + "tail", "en", "a", 0, *clash),
        (7, "x" * 300_000, "en", "c", 0, *clash),
        (8, "ÄÖ   non breaking \U0001f600 é", "de", "c", 0, *clash),
        (9, "one two", "de", "b", 3, *clash),
    ]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


class Union:
    """Union-find for brute-force components."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@pytest.fixture
def union():
    return Union()
