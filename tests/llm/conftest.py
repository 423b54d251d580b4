import pytest

#: Edge cases that every operator on documents must bear: null, empty, blank, repeated rows, ties, one long text.
ODD = [
    (None, "a row without an id, which stays as it is"),
    (1, None),
    (2, ""),
    (3, " \t\n \r\n"),
    (4, "the same text in two rows of one id " * 3),
    (4, "the same text in two rows of one id " * 3),
    (5, "the same text in two rows of one id " * 3),
    (6, "un élève 日本語 🎉 İstanbul ΟΔΟΣ  two  blanks \x1c\x85 end"),
    (7, "word " * 30000 + "mail me@example.org"),
    (8, "x" * 60000),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Columns with names that operators use inside."""
    rows = [(i, t, None, 7, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `row` int, `kind` string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
