import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, words int"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names operators use inside."""
    long = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
    rows = [
        (1, None, None, None, None, "k", 1),
        (2, "", "en", "a", 0, "k", 1),
        (3, " \n\t ", "en", None, 4, None, None),
        (4, "one two three four five six seven eight nine ten eleven", "en", "a", 55, "k", 1),
        (4, "one two three four five six seven eight nine ten eleven", "en", "a", 55, "k", 1),
        (5, long, "en", "b", len(long), "k", 1),
        (None, "no id but some words that are here to be counted as well", "en", "b", 10, "k", 1),
        (6, "12 34 !! ??", None, "b", 11, "k", 1),
    ]
    return spark.createDataFrame(rows, DOCS)
