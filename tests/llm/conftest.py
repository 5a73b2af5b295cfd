import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) tuples."""

    def make(rows, schema=DOC_SCHEMA):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *("en", "src1")[len(row) - 2 :]) if len(row) < 4 else row
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
