import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns of the input that clash with names an operator uses or returns.
CLASHING = ["tk", "fp", "lo", "hi", "piece", "length", "spans", "kept", "ids", "toxicity", "root", "node"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with columns whose names clash if asked."""

    def build(rows, clashing=False):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df

    return build


ODD = [None, "", " ", "\n\t", "a", "b a", "a b c d e f", "A B C D e f", "\x00x", "é ü 日本語 😀", "w " * 9000, "x" * 30000, "a b c d e f", None]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, very long ones, repeated rows, a null id, clashing columns."""
    return make([*enumerate(ODD), (3, ODD[3]), (None, "a b c d e f")], True)
