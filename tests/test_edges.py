"""Core operators on empty tables and rows with nulls."""

import pytest
from pyspark.sql.types import TimestampNTZType

from tracequarry.plans.registry import QUERIES

#: Queries that answer with several rows even without input.
FIXED: set[str] = set()


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    import os

    out = tmp_path_factory.mktemp("empty")
    for f in os.listdir(sf_dir):
        df = spark.read.parquet(f"{sf_dir}/{f}")
        df.limit(0).write.parquet(str(out / f))
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty_dir, name):
    rows = QUERIES[name](spark, empty_dir).collect()
    assert len(rows) <= 1 or name in FIXED


@pytest.fixture(scope="module")
def null_dir(spark, sf_dir, tmp_path_factory):
    import os

    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("null")
    for f in os.listdir(sf_dir):
        df = spark.read.parquet(f"{sf_dir}/{f}")
        holes = df.limit(20).select(*[F.lit(None).cast(t.dataType if not isinstance(t.dataType, TimestampNTZType) else "timestamp_ntz").alias(t.name) for t in df.schema.fields])
        df.limit(300).unionByName(holes.limit(2)).write.parquet(str(out / f))
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_null_rows(spark, null_dir, name):
    QUERIES[name](spark, null_dir).write.format("noop").mode("overwrite").save()
