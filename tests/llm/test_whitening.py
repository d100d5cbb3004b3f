"""Whitening against plain integer arithmetic, on odd vectors, and the query on the driver's smallest table."""

import math
import os
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import whitening
from barflow.llm.queries import op12

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(vectors):
    """n, sums, exact covariance of the distinct integer vectors."""
    x = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    cov = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x), n**3) for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(c) for c in row] for row in cov])


@pytest.mark.parametrize("spread", [0.3, 3.0, 1e12, 1e16])
def test_cross_products_are_exact(spread):
    rng = np.random.default_rng(3)
    x = (rng.normal(0, spread, (130, 5)) * 64).astype(np.int64) + 1_000_000
    x[:, 2] = 7
    sums, cross = whitening.cross_products(x, 1_000_000)
    y = [[int(v) - 1_000_000 for v in row] for row in x]
    assert list(sums) == [sum(r[i] for r in y) for i in range(5)]
    assert all(cross[i, j] == sum(r[i] * r[j] for r in y) for i in range(5) for j in range(5))


def check(rows, vectors):
    """Rows of the query against the brute force; ``vectors`` by id, without those left out."""
    n, s, cov = brute(vectors.values())
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    k = min(16, len(s))
    assert len(rows) == k * len(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for i, v in vectors.items():
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        assert all(got[i, c]["n"] == n and got[i, c]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s)) for c in range(1, k + 1))
    distinct = {tuple(math.floor(64 * c) for c in v): i for i, v in vectors.items()}.values()
    w = np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i in distinct])
    y = np.array([[(n * (math.floor(64 * c) + 1_000_000) - b) / n for c, b in zip(vectors[i], s)] for i in distinct])
    # projections on unit eigenvectors: their cross-covariance with the vectors is sqrt(e) times the eigenvector
    axes = (y.T @ w / n) / np.sqrt(values[:k])
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-8) and np.allclose(cov @ axes, axes * values[:k], atol=1e-8 * values[0])
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert all(abs(r["identity_error"] - error) < 1e-9 and r["identity_error"] < 1e-4 for r in rows)
    assert all(abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-8 for r in rows)


def test_query_equals_brute_force_on_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(0, 1, 20) * rng.uniform(0.1, 2, 20)).tolist() for i in range(200)}
    vectors |= {1000 + i: vectors[i % 5] for i in range(100)}  # copies
    rows = [(i, v, None) for i, v in vectors.items()]
    for at, bad in enumerate((None, float("nan"), float("inf"), -float("inf"))):
        rows.append((2000 + at, [0.5] * 19 + [bad], 1))
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.1] * 19, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "_x", "whitened", "deviation", "n", "at")})
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    check(op12(spark, str(tmp_path)).collect(), vectors)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_on_the_given_table(spark):
    check(op12(spark, SF).collect(), {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()})


@pytest.mark.parametrize("rows, want", [([], 0), ([(1, None, 1)], 0), ([(1, [], 1)], 0), ([(1, [0.5, 0.5], 1)], 2), ([(1, [0.5], 1), (None, [0.5], 1), (None, None, None)], 2)])
def test_no_variance_and_no_rows(spark, tmp_path, rows, want):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12(spark, str(tmp_path)).collect()
    assert len(got) == want and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in got)


def test_huge_entries_have_a_result(spark, tmp_path):
    spark.createDataFrame([(1, [1e300, 0.0], 1), (2, [-1e300, 1.0], 1), (3, [0.0, 2.0], 1)], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] < 3} == {None}
