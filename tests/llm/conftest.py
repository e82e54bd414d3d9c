import pytest



DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a repeated row, one very long word, and columns with clashing names."""
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, "plain words here", "en", "b", 16), (3, " \t\n ", "de", "a", 4),
        (4, "same text twice", "en", "a", 15), (4, "same text twice", "en", "a", 15), (5, "x" * 20_000, "en", "b", 20_000),
        (6, "Ünïcode wörds, ñ and 漢字 \U0001F600 stay whole", "fr", "c", 40), (7, "word " * 5_000, "en", "a", 25_000),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = ("size", "score", "label", "spans", "copies", "position", "fp", "source_size", "_text", "words", "value", "kept")
    return df.selectExpr("*", *[f"'clash' AS {n}" for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
