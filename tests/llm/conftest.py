import pytest

LONG = "wort " * 30000
#: Null, empty, blank, short, repeated, long, non-Latin; repeated and null ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here of six words"), (5, "same text here of six words"), (6, "same text here of six words"), (None, "same text here of six words"), (None, None), (7, LONG), (8, "日本 語 \U0001f600 é x <|endoftext|>  y"), (9, "a\n\n a\na")]


@pytest.fixture(scope="session")
def odd(spark):
    """Edge cases with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("lang", "source", "n_chars", "words", "label", "row", "score", "kept", "n_words", "section", "block", "component", "id", "key"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
