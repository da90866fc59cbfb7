import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard string, hits string, row string"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source]) as documents with extra columns whose names clash with the operators' own."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return build


@pytest.fixture
def hard(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return documents([
        (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (5, "same text here"), (5, "same text here"), (None, "no id"),
        (None, None), (6, long, None), (7, "é" * 30_000, None), (8, "x" * 50_000), (9, "same text here", "b")])
