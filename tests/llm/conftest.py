import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rid long, key string, rank int, mix_slot int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns that operators use themselves."""

    def make(texts, sources=None):
        rows = [(i, t, "en", (sources or ["src0"])[i % len(sources or [1])], None if t is None else len(t), True, 7, "k", 1, 2) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def rows(df):
    return [r.asDict(True) if isinstance(r, Row) else r for r in df.collect()]
