import pytest

NASTY = [
    None, "", " ", "\n\t", "a", "A a  A\ta", "same text here now", "same text here now", "same  text\nhere now ", "x" * 5000,
    "ab" * 3000, "word " * 1200, "é" * 900, "İstanbul ΑΣ ß 😀 " * 40, "one two three", "one two three four", "+1 (017) 555-7713 " * 60,
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    rows = [(n, t, "en", "src0", len(t or ""), n, "k") for n, t in enumerate(NASTY)]
    rows += [rows[6], rows[6], rows[9]]
    rows += [(None, "same text here now", None, None, None, None, None), (None, None, None, None, None, 7, "k"), (3, "other text under a known id", "en", None, 5, 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, salt string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def no_rows(small):
    return small.limit(0)
