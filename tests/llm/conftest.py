"""Documents with the awkward rows that every operator has to take."""

import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, copies, near copies, a long text, repeated rows, other white space."""
    base = " ".join(f"word{i % 97} item{i % 13}," for i in range(120))
    long = " ".join(f"long{i * i % 1013}" for i in range(9000))
    texts = [None, "", "   \n", "one", "one two", "One TWO", base, base, base + " extra", "x " + base, long, long + " tail", "tab\tand\x0bvertical\x1cunit é ñ Σ", "é" * 30, "a.b,c.d ,. !!! ok."]
    rows = [Row(doc_id=i * 7 % 31, text=t, lang="en", source="s", n_chars=len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], Row(doc_id=None, text=base, lang=None, source=None, n_chars=None), Row(doc_id=None, text=None, lang=None, source=None, n_chars=None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
