"""Column helpers shared by the operators that stay with DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(start: Column, sizes: Column) -> Column:
    empty = F.array().cast("array<int>")
    return F.aggregate(sizes, F.struct(start.alias("at"), empty.alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def starts(sizes: Column) -> Column:
    """Where each of array<int> sizes begins if they stand in a row.

    Sums run within parts of the root of the array's size, then over the parts: n * sqrt(n) copies instead of n * n.
    """

    def parted(a: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), step), lambda i: F.slice(a, i + 1, step))

    def whole(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y))
        return F.flatten(F.zip_with(_running(F.lit(0), sums), parts, _running))

    return let(let(sizes, parted), whole)
