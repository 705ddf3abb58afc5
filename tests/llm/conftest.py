import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node int"


@pytest.fixture(scope="session")
def table(spark):
    """Documents with columns whose names the operators use as well."""

    def make(rows):
        return spark.createDataFrame([(r + (None,) * 4)[:4] + (7, 0.5, 9, 1) for r in rows], DOCS)

    return make
