"""Ordinals over a whole table without one task for all rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranged(df: DataFrame, key: str, parts: int | None) -> DataFrame:
    """df dealt by ranges of key, in order within each (rows without a key last), with __part and __row, both rising."""
    order = F.asc_nulls_last(key)
    dealt = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    dealt = dealt.sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id())
    return dealt.withColumn("__part", F.shiftright("__row", 33)).checkpoint()


def _with_start(ranged: DataFrame, size: Column, name: str) -> DataFrame:
    """ranged with `name`, the sum of `size` (of an aggregate) over the ranges before a row's own, and __first, that range's
    first row. Of ranges there are as many as shuffle partitions, so their sums are a small table whatever df holds."""
    sums = ranged.groupBy("__part").agg(F.min("__row").alias("__first"), size.alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(sums.select("__part", "__first", F.coalesce(before, F.lit(0)).alias(name)), "__part")


def global_ordinal(df: DataFrame, key: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """df with 1, 2, ... in the order of a unique key.

    Rows are dealt by ranges of the key, each range numbers its own and is raised by the rows of the ranges before it.
    Rows without a key come last.
    """
    started = _with_start(ranged(df, key, parts), F.count("*"), "__before")
    return started.withColumn(name, F.col("__row") - F.col("__first") + F.col("__before") + 1).select(*df.columns, name)


def values_at(df: DataFrame, column: str, ranks: list[int], parts: int | None = None) -> list:
    """The values of a column (without nulls) at ranks, counted from 0.

    Equal values are counted before anything is dealt; counts are then summed along ranges of values, so neither all rows
    nor all different values meet in one task. No more rows than ranks are collected.
    """
    counts = df.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__n"))
    started = _with_start(ranged(counts, "__value", parts), F.sum("__n"), "__before")
    own = F.sum("__n").over(Window.partitionBy("__part").orderBy("__row"))
    ends = started.withColumn("__end", own + F.col("__before"))
    held = reduce(or_, [(F.col("__end") > r) & (F.col("__end") - F.col("__n") <= r) for r in ranks])
    found = ends.filter(held).select("__value", "__end", "__n").collect()
    return [next((r["__value"] for r in found if r["__end"] - r["__n"] <= rank < r["__end"]), None) for rank in ranks]


def sequence_digest(rows: DataFrame, keys: list[str], ordinal: str, value: str, name: str, chunk: int = 1000) -> DataFrame:
    """keys and one SHA-256 of each group's values in the order of their ordinals (1, 2, ... without gaps).

    Values are joined and hashed in chunks, then the chunks' hashes are, so that a long group isn't one row's list. Missing
    values are skipped.
    """
    joined = lambda o, v: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, v))), lambda s: s[v]), ","), 256)
    part = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor((F.col(ordinal) - 1) / chunk).alias("__chunk")).agg(joined(ordinal, value).alias("__hash"))
    return part.groupBy(*keys).agg(joined("__chunk", "__hash").alias(name))


def sequence_digest_sql(rows: str, keys: str, ordinal: str, value: str, name: str) -> str:
    """The same in SQL."""
    return f"SELECT {keys}, sha256(string_agg(h, ',' ORDER BY chunk)) AS {name} FROM (SELECT {keys}, ({ordinal} - 1) // 1000 AS chunk, sha256(string_agg({value}, ',' ORDER BY {ordinal})) AS h FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL) GROUP BY {keys}"
