import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm.queries import op13_whitening
from tracequarry.llm.whitening import by_component, jacobi, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, components=8):
    """{vec_id: (deviation, whitened up to sign)}, shares, n by numpy's own eigenvectors."""
    fit = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(1024 * float(c)) + 100000 for c in r[1]] for r in fit]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array(far, dtype=np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    y = centred @ vectors / np.sqrt(values)
    return {r[0]: (sum(v * v for v in f), w) for r, f, w in zip(fit, far, y, strict=True)}, values / np.trace(centred.T @ centred / n), n


def compared(spark, rows, got):
    expected, shares, n = brute(rows)
    assert len(got) == len(expected) * len(shares)
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        deviation, y = expected[r.vec_id]
        sign = signs.setdefault(r.component, 1 if r.whitened * y[r.component - 1] >= 0 else -1)
        assert r.n == n and r.deviation == deviation
        assert r.whitened * sign == pytest.approx(y[r.component - 1], abs=1e-7)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = op13_whitening(spark, sf_dir)
    assert out.columns == COLUMNS
    compared(spark, rows, out.collect())


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 33):
        a = rng.normal(size=(d, d))
        values, vectors = jacobi(a @ a.T)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a @ a.T, atol=1e-10)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
        assert (np.diff(values) <= 0).all()
    # A strongly graded matrix: the smallest of its eigenvalues is known to its own digits.
    scale = np.diag([1e8, 1e4, 1.0, 1e-4])
    core = np.full((4, 4), 0.3) + 0.7 * np.eye(4)
    values, _ = jacobi(scale @ core @ scale)
    assert values.prod() == pytest.approx(np.linalg.det(core) * np.diag(scale).prod() ** 2, rel=1e-12)
    assert (jacobi(np.zeros((3, 3)))[0] == 0).all()


def test_bad_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, float("nan"), 1.0, 1.0, 1.0]), (103, [1.0, float("inf"), 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 1.0, 1.0, 1.0, 1.0])]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in ("x", "y", "n", "s", "i", "k", "deviation", "explained")])
    compared(spark, rows, by_component(whiten(clashing)).collect())


def test_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-4, 5, 3)]) for i in range(40)]
    docs = spark.createDataFrame([*rows, *[(None, rows[0][1])] * 50, rows[1], rows[1]], "vec_id long, embedding array<double>")
    got = whiten(docs).collect()
    assert len(got) == 92 and len({(tuple(r.y), r.deviation) for r in got if r.vec_id is None}) == 1
    assert all(len(r.y) == 3 and r.identity_error < 1e-10 for r in got)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {(tuple(r.y), r.deviation, tuple(r.explained), r.identity_error) for r in whiten(same).collect()} == {((0.0, 0.0), 0, (0.0, 0.0), 0.0)}
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert all(abs(r.y[0]) > 0 or r.vec_id == 2 for r in whiten(flat).collect()) and {r.y[1] for r in whiten(flat).collect()} == {0.0}
    empty = by_component(whiten(same.limit(0)))
    assert empty.columns == COLUMNS and empty.count() == 0
