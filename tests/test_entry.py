import os

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SAMPLE_GENO, SAMPLE_PHENO, TESTDATA
from sparselm.plans import jobs


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="no test tables")
def test_entry_flagship(spark):
    rows = E.entry(spark).collect()
    # the λ=5 optimum on sf0.001 keeps 46 of 64 coefficients
    assert len(rows) == 46
    assert all(r["coef"] != 0 for r in rows)


def test_registry_consistent():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    from sparselm.plans import catalog

    assert set(catalog.QUERIES) <= set(sql)


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["gram", "alignment_report", "ridge_solve_p2", "admm_step",
                                  "lasso_onehot", "admm_three_rounds", "history_two_rounds",
                                  "lasso_lineitem", "streaming_statistics", "admm_history",
                                  "combined_scan", "interaction_files", "model_roundtrip",
                                  "cross_validation", "strong_path"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    sf = f"{TESTDATA}/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "labels", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[name](spark, sf)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(r[i] for i in order) for r in res.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float):
                assert abs(x - y) <= 1e-9 * max(1.0, abs(y))
            else:
                assert x == y


@pytest.mark.skipif(not (SAMPLE_GENO and os.path.exists(SAMPLE_GENO)),
                    reason="set SPARSELM_SAMPLE_GENO / SPARSELM_SAMPLE_PHENO")
def test_lasso_job(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "job")
    res = jobs.lasso_job(spark, SAMPLE_GENO, SAMPLE_PHENO, out, lam=0.5, rho="auto",
                         abs_tol=1e-8, rel_tol=1e-8, max_iter=20000)
    assert abs(res["fit"].objective() - 1.16073114) < 1e-6
    rep = res["report"].first()
    assert rep["joined_rows"] == 19 and rep["left_only_rows"] == 0
    hist = spark.read.parquet(os.path.join(out, "history"))
    assert hist.count() == res["fit"].iterations
    state = spark.read.parquet(os.path.join(out, "state")).count()
    assert state == 10
    assert np.isclose(res["model"].mse, 2 * (res["fit"].objective()
                                             - 0.5 * np.abs(res["fit"].coef).sum()) / 19)


def _handmade(folder):
    """19 samples x 10 markers of rank 7: two constant markers, one of zeros,
    one that repeats another; a response with small deviations."""
    rng = np.random.default_rng(19)
    X = rng.integers(0, 2, (19, 10)).astype(float)
    X[:, 4] = X[:, 9] = 1.0
    X[:, 5] = 0.0
    X[:, 7] = X[:, 2]
    y = 1.0 + 0.3 * X[:, 0] - 0.2 * X[:, 2] + 0.05 * rng.normal(size=19)
    assert np.linalg.matrix_rank(X) == 7
    ids = [f"s:{i}" for i in range(19)]
    with open(os.path.join(folder, "geno.tsv"), "w") as f:
        f.write("\t".join(["<Marker>", *(f"m{j}" for j in range(10))]) + "\n")
        f.writelines("\t".join([s, *map(str, x)]) + "\n" for s, x in zip(ids, X))
    with open(os.path.join(folder, "pheno.tsv"), "w") as f:
        f.write("id\ttrait\n")
        f.writelines(f"{s}\t{float(v)!r}\n" for s, v in zip(ids, y))
    return X, y


def test_lasso_job_on_handmade_files(spark, tmpdir_path):
    from test_admm import cd_lasso, obj

    X, y = _handmade(tmpdir_path)
    out = os.path.join(tmpdir_path, "job")
    for lam in (0.5, 100.0):
        res = jobs.lasso_job(spark, os.path.join(tmpdir_path, "geno.tsv"),
                             os.path.join(tmpdir_path, "pheno.tsv"), out, lam=lam, rho="auto",
                             n_blocks=3, abs_tol=1e-8, rel_tol=1e-8, max_iter=20000, strict=True)
        # the minimiser is not unique, its objective is
        assert abs(res["fit"].objective() - obj(X, y, cd_lasso(X, y, lam), lam)) < 1e-6
    assert res["fit"].nnz() == 0                    # above max|Aᵀb|
    assert res["report"].first()["joined_rows"] == 19
    assert spark.read.parquet(os.path.join(out, "state")).count() == 10


# fixed values: golden LASSO objectives (λ=5, all 64 dims, response `label`)
# on the driver's `embeddings` table, with their non-zero counts
EMB_GOLDEN = {"sf0.001": (6996.162401, 46), "sf0.01": (6525.344577, 49)}


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("sf", sorted(EMB_GOLDEN))
def test_golden_objective_on_embeddings(spark, sf):
    from pyspark.sql import functions as F

    from sparselm.operators import admm
    from sparselm.plans import catalog

    m = catalog.emb_matrix(spark, f"{TESTDATA}/{sf}")
    prob = admm.prepare(m.df, block_col=F.pmod(F.col("sample_id"), F.lit(4)), rho="auto")
    fit = admm.fit(prob, 5.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    want_obj, want_nnz = EMB_GOLDEN[sf]
    assert abs(fit.objective() - want_obj) < 1e-5
    assert fit.nnz() == want_nnz
