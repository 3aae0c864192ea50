"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import arrow_schema, bounded_batches, materialize

SCALE, SHIFT, COMPONENTS = 1024, 100000, 8
#: Entries from here on have no exact place on the grid.
LARGEST = float(1 << 40)


def jacobi(matrix: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Cyclic Jacobi in tournament order: every sweep meets each pair of rows once, in rounds of disjoint pairs that are
    rotated together. Sweeps end when no off-diagonal entry exceeds 2**-53 times the root of its two diagonal ones, which
    keeps small eigenvalues accurate, or when nothing is left to rotate.
    """
    d = len(matrix)
    a, v = np.array(matrix, dtype=np.float64), np.eye(d)
    even = d + d % 2
    for _ in range(most):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        if not (off > np.sqrt(np.outer(diagonal, diagonal)) * 2.0**-53).any():
            break
        seats = list(range(even))
        for _ in range(even - 1):
            pairs = [(min(x), max(x)) for x in zip(seats[: even // 2], reversed(seats[even // 2 :]), strict=True) if max(x) < d]
            p, q = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            seats = [seats[0], seats[-1], *seats[1:-1]]
            held = a[p, q] != 0
            p, q = p[held], q[held]
            if not len(p):
                continue
            with np.errstate(over="ignore", divide="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            kept_p, kept_q = a[p, p] - t * a[p, q], a[q, q] + t * a[p, q]
            left, right = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            left, right = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * left - s * right, s * left + c * right
            a[p, p], a[q, q] = kept_p, kept_q
            a[p, q] = a[q, p] = 0
            left, right = v[:, p].copy(), v[:, q].copy()
            v[:, p], v[:, q] = c * left - s * right, s * left + c * right
    else:
        raise RuntimeError(f"off-diagonal entries left after {most} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def on_grid(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, x: array<bigint>, floor(1024*c)+100000 of every entry c as double.

    Rows go whose vector is null, has a null or non-finite entry or one of 2**40 or more, or isn't of the length that most
    have (of two lengths equally common, the longer). Vectors of length 0 go.
    """
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)  # noqa: E731  NaN is above all numbers
    fit = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry))
    common = fit.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    fit = fit.filter(F.size(vector) == (common["d"] if common else 0))
    return fit.select("vec_id", F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("bigint")).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(grid: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of every dimension; each task sends one row a dimension, added up before anything is collected."""
    target = arrow_schema("i int, n bigint, s decimal(38,0)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", len(batch.column(0)[0]))
                high, low = (x >> 20).sum(axis=0).tolist(), (x & 0xFFFFF).sum(axis=0).tolist()
                n, own = n + len(x), [(h << 20) + w for h, w in zip(high, low, strict=True)]
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.decimal128(38, 0))], schema=target)

    bounded_batches(grid.sparkSession)
    rows = grid.select("x").mapInArrow(run, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    rows.sort(key=lambda r: r["i"])
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def scatter(rows: DataFrame, name: str, d: int, centred) -> np.ndarray:
    """Sum of the outer products of centred(rows' arrays). A task sends a row of d numbers for each of d dimensions; they
    are added up by dimension before the d*d sums are collected."""
    target = arrow_schema("i int, s array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for batch in batches:
            if batch.num_rows:
                c = centred(_matrix(batch, name, d))
                total, some = total + c.T @ c, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total))], schema=target)

    bounded_batches(rows.sparkSession)
    sent = rows.select(name).mapInArrow(run, "i int, s array<double>")
    added = sent.groupBy("i").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(d)]).alias("s")).collect()
    out = np.zeros((d, d))
    for r in added:
        out[r["i"]] = r["s"]
    return out


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, y (whitened coordinates, one a component), explained and identity_error of every fit row.

    Covariances are over all fit rows with divisor n. Rows are centred exactly, as n*x - sums in whole numbers, then
    divided by n; tasks sum outer products; the driver gets d*d sums, rotates them (jacobi), and sends the d*components
    matrix with the tasks. A component without variance (at or below rounding: 2**-40 of the trace) has coordinate 0 and
    stays out of identity_error, which is the largest entry of the others' covariance, measured over all rows, less the
    identity; 0 if there is none. deviation is exact; null if it is 2**63 or more. Equal rows get equal values. No fit rows:
    no rows. Other columns don't matter; vec_id may be null or repeated.
    """
    grid = materialize(on_grid(rows, vector), "grid")
    n, total = sums(grid)
    d = len(total)
    width = min(components, d)
    if not n:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, n bigint, deviation bigint, y array<double>, explained array<double>, identity_error double")
    small = all(abs(s) < 1 << 62 for s in total)

    def far(x: np.ndarray) -> np.ndarray:
        """n*x - sums, exact; as Python numbers where they may pass 64 bits."""
        if small and int(np.abs(x).max()) < (1 << 62) // n:
            return x * np.int64(n) - np.array(total, dtype=np.int64)
        return x.astype(object) * n - np.array(total, dtype=object)

    def centred(x: np.ndarray) -> np.ndarray:
        return far(x).astype(np.float64) / n

    values, vectors = jacobi(scatter(grid, "x", d, centred) / n)
    trace = float(values.sum())
    held = values[:width] > trace * 2.0**-40
    weights = np.where(held, vectors[:, :width] / np.sqrt(np.where(held, values[:width], 1.0)), 0.0)

    def deviation(x: np.ndarray) -> list:
        far_x = far(x)
        if far_x.dtype != object and (far_x.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62:
            return (far_x * far_x).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in far_x]
        return [v if v < 1 << 63 else None for v in exact]

    ddl = "vec_id bigint, deviation bigint, y array<double>"
    target = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", d)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation(x), pa.int64()), pa.array(list(centred(x) @ weights), pa.list_(pa.float64()))], schema=pa.schema([("vec_id", batch.schema.field(0).type), *list(target)[1:]])).cast(target)

    out = materialize(grid.select("vec_id", "x").mapInArrow(run, ddl), "whitened")
    mean = out.agg(*[F.avg(F.col("y")[k]).alias(f"m{k}") for k in range(width)]).first()
    middle = np.array([mean[k] for k in range(width)])
    error = np.abs(scatter(out, "y", width, lambda y: y - middle) / n - np.eye(width))[np.ix_(held, held)]
    shares = F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in values[:width]])
    return out.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "y", shares.alias("explained"), F.lit(float(error.max()) if held.any() else 0.0).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    each: Column = F.posexplode(F.arrays_zip("y", "explained"))
    return whitened.select("vec_id", "n", "deviation", "identity_error", each.alias("k", "c")).select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.y").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
