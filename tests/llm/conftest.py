import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text) pairs, with columns whose names clash with those of the operators."""

    def build(rows, lang=None, extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        docs = spark.createDataFrame([(i, t, lang(i) if lang else "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            for name in ("score", "n_words", "label", "bag", "node", "y", "_n", "n", "key", "ids", "kept"):
                docs = docs.selectExpr("*", f"'x' AS {name}")
        return docs.repartition(3)

    return build
