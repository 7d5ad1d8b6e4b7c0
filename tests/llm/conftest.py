import pytest


@pytest.fixture
def rows_of():
    def read(df, *columns):
        return [tuple(r) for r in df.select(*columns).collect()]
    return read


@pytest.fixture
def documents(spark):
    """A documents table with nulls, empty and repeated rows and clashing extra columns."""
    def build(texts, sources=None):
        rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], 0, i, "x", 7, 1.5) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, rank string, grade int, size double")
    return build
