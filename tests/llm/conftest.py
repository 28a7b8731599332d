import pytest

#: Extra columns whose names clash with what operators use inside.
CLASHES = "kept boolean, size string, target string, words string, node string, row_ string, text_ string, mix_size string, n long, loss_from string, licenses string, secret_spans string"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text, source) rows, with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), True, "a", "b", "c", "d", "e", "f", "g", 1, "x", "l", "s") for i, t, s in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(2)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no id here", "a"), (4, long, "b"), (5, "same text twice", "b"), (5, "same text twice", "b"), (6, "same text twice", None), (7, "x", "c")]
