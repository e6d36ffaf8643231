import pytest


@pytest.fixture
def docs_of(spark):
    def make(texts, **extra):
        """Rows (doc_id, text, lang, source, n_chars) of texts or (id, text) pairs."""
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
