import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, uid long, key string, component_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest driver table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
    same = "the quick brown fox jumps over the lazy dog and runs home again before the rain comes down " * 4
    texts = [None, "", " ", long, "x" * 5000, same, same, same + "end", "mail a.b@c.de now", "é" * 300, "a\u0000b  c\n\nd"]
    rows = [(i, t, None, "s", len(t or ""), 0.5, 1, "k", "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, same, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter(F.lit(False))
