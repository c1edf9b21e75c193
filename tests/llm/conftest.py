import pytest


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as a documents table, with a column of a clashing name."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "kept") for i, t, s in ((*r, "src1")[:3] for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string")

    return make


@pytest.fixture
def folder(tmp_path):
    """A table written where queries look for it."""

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
