import pytest
from helpers import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Nulls in every column, empty and very long texts, repeated rows and columns whose names clash."""
    long = " ".join(f"word{i % 7919} x{i}" for i in range(40_000))
    rows = [(None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", "en", "s", 0), (900003, " \n\t ", None, "s", 4), (None, "one two three four five six seven.", "en", None, None), (900004, long, "en", "s", len(long)), (900005, "a" * 5000, "en", "s", 5000), (900006, "...!", "en", "s", 4), (900007, "é" * 300 + " <|endoftext|> ü.", "de", "s", 1)]
    made = spark.createDataFrame(rows + rows, DOCS).union(docs.limit(30)).union(docs.limit(10))
    for name in ("r1", "_row_hash", "runs", "_runs", "_q", "node", "key", "sig", "m", "n"):
        made = made.withColumn(name, made["doc_id"] * 0 + 7)
    return made


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
