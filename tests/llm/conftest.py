import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, keys string, n long, h string, d string"

#: Nulls in any column, empty and blank texts, repeats, a long text, columns whose names the operators use too.
ODD = [
    (1, None, None, None, None, "x", 1, "y", "z"),
    (2, "", "en", "a", 0, None, None, None, None),
    (3, " \n\t ", "en", "a", 4, None, None, None, None),
    (4, "one two three four five six seven", "en", None, 3, None, None, None, None),
    (5, "One TWO three four five six seven", "en", "b", 3, None, None, None, None),
    (6, "1 2 3 \U0001f600 4", None, "b", 3, None, None, None, None),
    (7, "word " * 30_000, "en", "b", 150_000, None, None, None, None),
    (7, "word " * 30_000, "en", "b", 150_000, None, None, None, None),
    (None, "a text without an id, long enough to hold some words", "en", "c", 5, None, None, None, None),
    (8, "x", "de", "c", 1, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
