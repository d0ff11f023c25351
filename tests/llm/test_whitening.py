"""Whitening against numpy, exact sums against Python's whole numbers, and clustered eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(n, sums, covariance) in exact fractions."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - total[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, total, v, y


def check(spark, rows, kind="float", tolerance=1e-9):
    vectors = spark.createDataFrame(list(enumerate(rows)), f"vec_id long, embedding array<{kind}>")
    kept = {r["vec_id"]: list(r["embedding"]) for r in vectors.collect()}
    n, total, v, y = brute(list(kept.values()))
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    got = {}
    for r in whitening.whiten(vectors).collect():
        got.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(got) == list(range(1, min(8, len(v)) + 1))
    for k, rows_of in got.items():
        assert set(rows_of) == set(kept)
        for at, i in enumerate(kept):
            r = rows_of[i]
            assert r["n"] == n and r["deviation"] == sum(a * a for a in y[at])
            assert math.isclose(r["explained"], values[k - 1] / np.trace(v), rel_tol=1e-9) and r["identity_error"] < 1e-9
        mine = np.array([rows_of[i]["whitened"] for i in kept])
        theirs = np.array([[float(Fraction(a, n)) for a in row] for row in y]) @ basis[:, k - 1] / math.sqrt(values[k - 1])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < tolerance, k


def test_equal_to_numpy_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    check(spark, (rng.normal(size=(400, 12)) * np.linspace(1, 3, 12)).tolist())
    check(spark, rng.normal(size=(50, 3)).tolist(), "double")
    check(spark, rng.normal(size=(30, 1)).tolist())


def test_all_embeddings_of_a_table(spark):
    rows = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()]
    check(spark, rows, tolerance=1e-8)


@pytest.mark.parametrize("spread", [0.0, 1e-15, 1e-12, 1e-9, 1e-6])
def test_clustered_eigenvalues(spread):
    rng = np.random.default_rng(5)
    d = 40
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = np.concatenate([5 + spread * np.arange(6), 2 + spread * np.arange(4), np.linspace(0.1, 1, d - 10)])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.eigenvectors(v)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-13
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14
    assert np.abs(v.astype(np.longdouble) @ x - x * got).max() < 2e-14  # to double precision, which float32 alone is far from


def test_refinement_mends_single_precision():
    rng = np.random.default_rng(6)
    v = np.cov(rng.normal(size=(64, 500)))
    rough = np.linalg.eigh(v.astype(np.float32))[1]
    assert np.abs(v @ rough - rough * np.diag(rough.T @ v @ rough)).max() > 1e-8
    values, x = whitening.refine(v, rough)
    assert np.abs(v.astype(np.longdouble) @ x - x * values).max() < 2e-15 and np.abs(values - np.sort(np.linalg.eigvalsh(v))[::-1]).max() < 1e-14


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [3.0, 5.5], [3.0, 5.5]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(None, [0.5, 0.25], "x"), (1, [4.0, 4.0], "x"), (10, None, "x"), (11, [nan, 1.0], "x"), (12, [inf, 1.0], "x"), (13, [None, 1.0], "x"), (14, [], "x"), (15, [1.0], "x")]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")).collect()
    assert {r["vec_id"] for r in out} == {0, 1, 2, 3, None} and len(out) == 12 and {r["n"] for r in out} == {6} and {r["component"] for r in out} == {1, 2}


def test_no_rows_one_row_no_variance_and_large_entries(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([("a", None)])).columns[0] == "vec_id"
    one = whitening.whiten(make([("a", [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [("a", 1, 1, 0, None, 0.0, None), ("a", 2, 1, 0, None, 0.0, None)]
    flat = whitening.whiten(make([("a", [1.0, 5.0]), ("b", [2.0, 5.0])])).collect()
    assert {(r["vec_id"], r["component"], r["whitened"] and abs(round(r["whitened"], 12)), round(r["explained"], 12)) for r in flat} == {("a", 1, 1.0, 1.0), ("b", 1, 1.0, 1.0), ("a", 2, None, 0.0), ("b", 2, None, 0.0)}
    huge = whitening.whiten(make([("a", [1e300, 0.0]), ("b", [-1e300, 0.0]), ("c", [1e12, 1.0])])).collect()
    assert all(r["deviation"] is None and int(r["deviation_digits"]) > 2**63 for r in huge if r["vec_id"] != "c") and len(huge) == 6
