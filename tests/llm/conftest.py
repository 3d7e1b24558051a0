import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])

#: Extra columns whose names operators use inside.
CLASHES = ["row", "host", "node", "words", "key", "fp", "size", "h", "n", "p", "q", "at", "cell", "score", "path", "of", "kept", "length", "worker", "toxic", "root"]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, and clashing columns."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and then runs away from it.", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog and then runs away from it.", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog and then runs away from it.", None, None, None),
        (3, None, "en", "a", None), (4, "", "de", "b", 0), (5, " \n\t ", "de", "b", 4), (None, "ein text ohne nummer aber mit vielen worten darin steht hier", "de", None, 3),
        (None, None, None, None, None), (6, long_text, "en", "a", 9), (7, "éè   　 café 12 34 !! \x00 x", "fr", "c", 2), (8, "12 34 56", None, "c", 2), (-9, "naïve \U0001f600 text", "fr", "", 2),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
