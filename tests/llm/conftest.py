import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """docs(texts or rows): a documents table from texts, or from (doc_id, text, source) rows."""

    def make(rows, extra=False):
        full = [(r if isinstance(r, tuple) else (i, r, f"src{i % 3}")) for i, r in enumerate(rows)]
        out = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in full]
        df = spark.createDataFrame(out, DOCS)
        if extra:  # columns whose names the operators use inside
            for c in ("sig", "th", "label", "key", "line", "_id", "copies", "size", "n", "_n", "_score", "_new", "_drop"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, repeated, very long and unspaced texts."""
    return [None, "", " \t\n", "one", "one", "two words", "a b c d e f g " * 3000, "x" * 70_000, "é" * 500 + " " + "漢字" * 300, "line one here\n\nline two here", "repeat me please"] + ["repeat me please"]
