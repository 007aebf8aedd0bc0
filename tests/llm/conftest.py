import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
                                      ("source", T.StringType()), ("n_chars", T.LongType()))]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text[, source])`` rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
