import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def frame(spark, tmp_path):
    """Rows (doc_id, text[, lang, source]) as a documents table in a Parquet folder; gives (path, DataFrame)."""

    def make(rows, name="documents"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(full, DOCS).repartition(2).write.parquet(path)
        return path, spark.read.parquet(path)

    return make


ODD = [(1, "a b c d e f g", "en", "x"), (1, "a b c d e f g", "en", "x"), (None, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "y"), (None, "Q", "fr", "y"), (4, "wörd " * 9000, "de", "x")]


@pytest.fixture
def odd():
    return list(ODD)
