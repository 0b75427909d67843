import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselm.operators import moments


def _data(spark, n=300, p=5, seed=1, parts=4):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    y = X @ rng.normal(size=p) + rng.normal(size=n)
    g = rng.integers(0, 3, size=n)
    rows = [(int(i), int(g[i]), X[i].tolist(), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, grp int, features array<double>, "
                                     "label double").repartition(parts)
    return df, X, y, g


def test_moments_match_numpy(spark):
    df, X, y, _ = _data(spark)
    rows = moments.moments(df).orderBy("i").collect()
    G = moments.full_from_upper_rows([r["g"] for r in rows], 5)
    assert np.allclose(G, X.T @ X)
    assert all(len(r["g"]) == 5 - r["i"] for r in rows)      # upper triangle only
    full = moments.gram(moments.moments(df), upper=False).collect()
    assert len(full) == 25
    assert all(np.isclose(r["g"], (X.T @ X)[r["i"], r["j"]]) for r in full)
    assert np.allclose([r["c"] for r in rows], X.T @ y)
    assert np.allclose([r["s"] for r in rows], X.sum(axis=0))
    assert rows[0]["n"] == len(y) and np.isclose(rows[0]["yy"], y @ y)


def test_grouped_moments_and_views(spark):
    df, X, y, g = _data(spark)
    mom = moments.moments(df, keys=["grp"])
    for k in range(3):
        sel = g == k
        rows = mom.where(F.col("grp") == k).orderBy("i").collect()
        assert np.allclose(moments.full_from_upper_rows([r["g"] for r in rows], 5),
                           X[sel].T @ X[sel])
    norms = {r["grp"]: r["sq_norm"] for r in moments.block_sq_norms(mom, ["grp"]).collect()}
    assert np.isclose(norms[1], (X[g == 1] ** 2).sum())
    means = moments.column_means(moments.moments(df)).orderBy("i").collect()
    assert np.allclose([r["mean"] for r in means], X.mean(axis=0))
    upper = moments.gram(moments.moments(df)).count()
    assert upper == 5 * 6 // 2


def test_ridge_solve(spark):
    df, X, y, g = _data(spark)
    res = moments.ridge_solve(df, ["grp"], rho=2.0).collect()
    for k in range(3):
        sel = g == k
        want = np.linalg.solve(X[sel].T @ X[sel] + 2.0 * np.eye(5), X[sel].T @ y[sel])
        got = np.array([r["x"] for r in sorted(res, key=lambda r: r["i"]) if r["grp"] == k])
        assert np.allclose(got, want)


def test_ragged_rows_rejected(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0], 2.0)], "features array<double>, "
                                                                   "label double").coalesce(1)
    with pytest.raises(Exception):
        moments.moments(df).collect()


def test_accumulator_budget_flushes_without_changing_sums(spark):
    from sparselm.operators import moments as M

    df, X, y, g = _data(spark, n=400, p=5, parts=2)
    full = {(r["grp"], r["i"]): r["g"] for r in M.moments(df, keys=["grp"]).collect()}
    old = M.ACCUMULATOR_BUDGET_BYTES
    M.ACCUMULATOR_BUDGET_BYTES = 1        # flush after every batch
    try:
        tiny = {(r["grp"], r["i"]): r["g"] for r in M.moments(df, keys=["grp"]).collect()}
    finally:
        M.ACCUMULATOR_BUDGET_BYTES = old
    assert full.keys() == tiny.keys()
    assert all(np.allclose(full[k], tiny[k]) for k in full)


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, "x", [1.0], 2.0), (None, "x", [2.0], 1.0),
                                (7, None, [3.0], 1.0), (7, "x", [5.0], 2.0)],
                               "a int, b string, features array<double>, label double")
    got = {(r["a"], r["b"]): (r["n"], r["c"]) for r in
           moments.moments(df, keys=["a", "b"]).collect()}
    assert got == {(None, "x"): (2, 4.0), (7, None): (1, 3.0), (7, "x"): (1, 10.0)}
    x = {(r["a"], r["b"]): r["x"] for r in moments.ridge_solve(df, ["a", "b"]).collect()}
    assert abs(x[(None, "x")] - 4.0 / 6.0) < 1e-12 and set(x) == set(got)
