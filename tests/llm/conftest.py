import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, source) rows, with columns whose names clash."""

    def make(rows, extra=()):
        schema = T.StructType(DOCUMENTS.fields + [T.StructField(x, T.StringType()) for x in extra])
        full = [(i, t, "en", s, None if t is None else len(t), *("x",) * len(extra)) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd_documents(documents):
    """Null ids, texts and sources, empty and blank texts, repeated rows, a very long text."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
    rows = [
        (1, "One two three four five six seven.", "a"), (1, "One two three four five six seven.", "a"),
        (2, None, "a"), (3, "", None), (4, " \t\n ", "b"), (None, "A row without id, some words here.", "b"), (None, None, None),
        (5, long, "a"), (6, long + " more", "c"), (7, "x", "c"), (8, "ünï ✓ 日本 😀", "c"),
    ]
    return documents(rows, extra=("size", "key", "shard", "score", "row", "taken", "ids"))
