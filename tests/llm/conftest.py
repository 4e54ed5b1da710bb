"""Small tables of odd rows that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, first=0, source="s"):
    return [(first + i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    rows = rows_of(["", None, "a", "a b c\nd e f\ng h i\nj", long, "tie", "tie", "Ünïcödé ﬁ ß 漢字 \x00 \x1c x"]) + [(None, "null id", None, None, None), (None, None, None, None, None), (3, "a b c\nd e f\ng h i\nj", "en", "s", 1), (3, "a b c\nd e f\ng h i\nj", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
