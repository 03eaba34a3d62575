import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table; extra columns clash with what operators return."""
    def make(rows, clash=False):
        df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
        return df.selectExpr("*", "'x' AS score", "1 AS piece", "'y' AS fingerprint", "2 AS k", "3 AS row", "4 AS size", "5 AS taken") if clash else df

    return make


#: nulls in every column, empty and blank texts, a long one, ties and repeated rows
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (4, "two words", "fr", "b", 9),
    (None, "no id at all here", "en", "b", 17), (None, None, None, None, None), (5, "the cat sat on the mat and the dog " * 4000, "en", "a", None),
    (6, "123 456 !!", "en", "a", 10), (7, "der Hund läuft über die Straße 漢字", "de", "b", 30), (-8, "le chat est là", "fr", "c", 14), (9, "le chat est là", "fr", "c", 14),
]
