import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns that clash with results."""
    long = " ".join(f"word{k % 977} Thing {k}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (None, "a text without an id", "en", "s", 20), (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)), (7, "you are an idiot.", "en", "s", 17), (7, "you are an idiot.", "en", "s", 17), (9, "été 中文 \U0001f600 ' 'll it's", None, "s", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = "n_tokens score kept class_id held_out n_bytes ids spans block rest rep bands y node component predicted n_links".split()
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
