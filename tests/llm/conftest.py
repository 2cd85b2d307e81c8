import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid int, node string, key int, label int, mix_slot int, _digest string"


@pytest.fixture()
def docs(spark):
    """Rows to documents with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, "n", 2, 3, 4, "d") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture()
def messy(docs):
    """Null ids, null and empty texts, ties, repeated rows, one long text."""
    long = " ".join(f"w{i % 977}é" for i in range(30000))
    return docs([(1, None, "a"), (2, "", None), (3, "one", "a"), (4, "one", "a"), (4, "one", "a"), (None, "one", "b"), (None, None, "b"),
                 (5, long, "a"), (6, long, "a"), (7, "x\ty\n z", "c"), (8, "퟿ 🙂 漢字", "c")])
