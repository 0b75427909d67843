"""Fold errors, the screened path and the split by features against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselm.operators import admm, local_fit, sharing, tune


def _table(spark, n=90, p=8, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    y = X[:, :3] @ np.array([2.0, -1.0, 0.5]) + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(n)],
                               "i int, features array<double>, label double")
    return df.repartition(3), X, y


def _lasso(X, y, lam, sweeps=3000):
    """Coordinate descent, to the end."""
    z, d = np.zeros(X.shape[1]), (X * X).sum(axis=0)
    for _ in range(sweeps):
        for k in range(len(z)):
            g = X[:, k] @ (y - X @ z) + d[k] * z[k]
            z[k] = np.sign(g) * max(abs(g) - lam, 0) / d[k]
    return z


def test_local_fit_of_moments():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 6))
    y = X[:, 0] - X[:, 4] + 0.1 * rng.normal(size=40)
    Z, rounds, ok = local_fit.fit_moments(X.T @ X, X.T @ y, [0.0, 2.0, 1e6])
    assert ok.all() and rounds.min() > 0
    for z, lam in zip(Z, (0.0, 2.0, 1e6)):
        assert np.allclose(z, _lasso(X, y, lam, 300), atol=1e-5)
    Z, _, ok = local_fit.fit_moments(np.zeros((0, 0)), np.zeros(0), [1.0])
    assert Z.shape == (1, 0) and ok.all()


def test_cross_validation_equals_refitting(spark):
    df, X, y = _table(spark)
    lambdas = [20.0, 2.0, 0.1]
    got = tune.cross_validate(df, lambdas, fold_col=F.col("i") % 4).collect()
    assert len(got) == 12
    for r in got:
        held = np.arange(90) % 4 == r["fold"]
        z = _lasso(X[~held], y[~held], r["lambda"], 200)
        assert np.allclose(r["coef"], z, atol=1e-4) and r["n"] == held.sum()
        assert r["mse"] == pytest.approx(((y[held] - X[held] @ z) ** 2).mean(), rel=1e-3)
    res = tune.cross_validate(df, lambdas, folds=3)
    again = tune.cross_validate(df.repartition(7), lambdas, folds=3)
    key = lambda rows: sorted((r["fold"], r["pos"], r["n"], round(r["mse"], 8)) for r in rows)
    assert key(res.collect()) == key(again.collect())
    best = tune.cross_validated_best(res).where("best").collect()
    assert len(best) == 1 and best[0]["n"] == 90
    with pytest.raises(ValueError, match="two folds"):
        tune.cross_validate(df, lambdas, fold_col=F.lit(0))


def test_equal_folds_are_a_tie_in_any_order_of_rows(spark):
    sse = [0.1, 0.2, 0.3]                       # 0.6000000000000001, backwards 0.6
    rows = [(f, 0, 8.0, 1, sse[f]) for f in (0, 1, 2)] + [(f, 1, 9.0, 1, sse[f]) for f in (2, 1, 0)]
    df = spark.createDataFrame(rows, "fold long, pos int, lambda double, n long, sse double")
    got = {r["pos"]: r for r in tune.cross_validated_best(df.coalesce(1)).collect()}
    assert got[0]["mse"] == got[1]["mse"] and got[0]["best"] and not got[1]["best"]


@pytest.mark.parametrize("kw", [{"n_blocks": 3}, {"mode": "fat", "rows_per_block": 20}])
def test_screened_path_is_the_unscreened_one(spark, kw):
    df, X, y = _table(spark, p=12)
    prob = admm.prepare(df, rho="auto", **kw)
    lambdas = [5.0, 60.0, 20.0, 1e6, 0.5]
    res = tune.strong_path(prob, lambdas)
    for lam, z in zip(lambdas, res.coefs):
        assert np.allclose(z, _lasso(X, y, lam, 300), atol=1e-4)
    rows = {r["lambda"]: r for r in res.results.collect()}
    assert rows[1e6]["screened"] == rows[1e6]["nnz"] == 0
    assert all(r["nnz"] <= r["screened"] + r["repaired"] <= 12 and r["converged"]
               for r in rows.values())
    assert any(r["screened"] < 12 for r in rows.values())
    # more remaining features than the bound: the whole fit, the same answer
    few = tune.strong_path(prob, [20.0], most=1, max_iter=3000, abs_tol=1e-8, rel_tol=1e-8)
    assert np.allclose(few.coefs[0], _lasso(X, y, 20.0, 300), atol=1e-3)


def test_repair_adds_what_the_rule_left_out(spark, monkeypatch):
    """A gradient that hides a feature from the rule does not change the answer."""
    df, X, y = _table(spark, p=6)
    prob = admm.prepare(df, n_blocks=2, rho="auto")
    true_c = prob.xty
    lam = 0.9 * float(np.abs(true_c).max())
    res = tune.strong_path(prob, [lam])
    hidden = true_c.copy()
    hidden[np.abs(true_c).argmax()] = 0.0

    class Shown(np.ndarray):
        pass

    # the first screening sees the altered gradient only
    shown = true_c.view(Shown)
    shown.copy = lambda: hidden.copy()
    prob.xty = shown
    again = tune.strong_path(prob, [lam])
    assert again.results.first()["repaired"] >= 1
    assert np.allclose(again.coefs, res.coefs, atol=1e-6)


@pytest.mark.parametrize("pairs", [False, True])
def test_split_by_features_reaches_the_optimum(spark, pairs):
    df, X, y = _table(spark, n=40, p=7)
    A = X
    if pairs:
        k, j = np.triu_indices(7, 1)
        A = np.concatenate([X, X[:, k] * X[:, j]], axis=1)
    cols = sharing.column_blocks(df, n_blocks=4, pairs=pairs)
    assert cols.n_blocks == 4 and cols.p == A.shape[1] and sorted(cols.b) == sorted(y)
    for lam in (3.0, 1e6):
        f = sharing.fit_sharing(cols, lam, abs_tol=1e-8, rel_tol=1e-8)
        assert f.converged and np.allclose(f.coef, _lasso(A, y, lam, 400), atol=1e-4)
        rows = sharing.optimality(cols, f.coef, lam, 1e-2).orderBy("idx").collect()
        assert [r["idx"] for r in rows] == list(range(A.shape[1]))
        assert all(r["kkt_ok"] for r in rows)
        assert np.allclose([r["xty"] for r in rows], A.T @ y)
    bad = sharing.optimality(cols, np.ones(A.shape[1]), 3.0, 1e-2).collect()
    assert not all(r["kkt_ok"] for r in bad)
    cols.release()
    with pytest.raises(ValueError, match="no rows"):
        sharing.column_blocks(df.limit(0))


@pytest.mark.parametrize("pairs", [False, True])
def test_tall_tables_are_split_as_equivalent_rows(spark, pairs, monkeypatch):
    """Blocks of a tall table grow with its columns only; rounds are the same."""
    df, X, y = _table(spark, n=6000, p=7)
    p = 28 if pairs else 7
    cols = sharing.column_blocks(df, n_blocks=4, pairs=pairs)
    assert (cols.n, len(cols.b), cols.n_blocks) == (6000, p + 1, 4)
    monkeypatch.setattr(sharing, "REDUCED_ROWS", 1 << 30)
    whole = sharing.column_blocks(df, n_blocks=4, pairs=pairs)
    assert (whole.n, len(whole.b)) == (6000, 6000)
    for lam in (3.0, 300.0):
        f, g = (sharing.fit_sharing(c, lam, abs_tol=1e-7, rel_tol=1e-7) for c in (cols, whole))
        assert f.converged and f.iterations == g.iterations
        assert np.allclose(f.coef, g.coef, atol=1e-8)
        a, b = (sharing.optimality(c, f.coef, lam, 1e-2).orderBy("idx").collect()
                for c in (cols, whole))
        assert all(r["kkt_ok"] for r in a) and all(r["kkt_ok"] for r in b)
        assert np.allclose([r["xty"] for r in a], [r["xty"] for r in b])
    cols.release()
    whole.release()


def test_many_fat_blocks_start_at_the_summed_optimum(spark, monkeypatch):
    """Rounds do not grow with the number of blocks."""
    df, X, y = _table(spark, n=800, p=7)
    prob = admm.prepare(df, mode="fat", rows_per_block=5, rho="auto")
    assert prob.n_blocks >= 160
    kw = {"max_iter": 5000, "abs_tol": 1e-8, "rel_tol": 1e-8}
    for lam, f in zip((3.0, 300.0), admm.fit_many(prob, (3.0, 300.0), **kw)):
        assert f.converged and f.iterations <= 3
        assert np.allclose(f.coef, _lasso(X, y, lam, 400), atol=1e-5)
    # a poor start is corrected by the rounds
    monkeypatch.setattr(local_fit, "support_fit", lambda G, c, lam: np.ones(len(c)))
    g = admm.fit(prob, 300.0, **kw)
    assert g.converged and g.iterations > 3 and np.allclose(g.coef, f.coef, atol=1e-5)
    prob.release()
