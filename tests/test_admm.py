import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE_GENO, SAMPLE_PHENO
from sparselm.operators import admm, align, tune
from sparselm.sources import text


def cd_lasso(X, y, lam, iters=20000, tol=1e-13):
    """Brute-force reference: cyclic coordinate descent on ½‖Xb−y‖² + λ‖b‖₁."""
    p = X.shape[1]
    b = np.zeros(p)
    r = y.copy()
    col = (X ** 2).sum(axis=0)
    for _ in range(iters):
        delta = 0.0
        for j in range(p):
            if col[j] == 0:
                continue
            rho_j = X[:, j] @ r + col[j] * b[j]
            new = np.sign(rho_j) * max(abs(rho_j) - lam, 0.0) / col[j]
            if new != b[j]:
                r -= X[:, j] * (new - b[j])
                delta = max(delta, abs(new - b[j]))
                b[j] = new
        if delta < tol:
            break
    return b


def obj(X, y, b, lam):
    e = X @ b - y
    return 0.5 * e @ e + lam * np.abs(b).sum()


def _random(spark, n=120, p=6, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    beta = np.array([2.0, -1.5, 0.0, 0.0, 0.7, 0.0])[:p]
    y = X @ beta + 0.3 * rng.normal(size=n)
    df = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(n)],
                               "sample_id long, features array<double>, label double")
    return df, X, y


@pytest.mark.parametrize("blocks", [1, 3])
def test_fit_matches_coordinate_descent(spark, blocks):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(blocks)), rho="auto")
    for lam in (1.0, 15.0):
        f = admm.fit(prob, lam, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
        ref = cd_lasso(X, y, lam)
        assert f.converged
        assert np.allclose(f.coef, ref, atol=1e-6)
        assert abs(f.objective() - obj(X, y, ref, lam)) < 1e-6
        assert f.history().count() == f.iterations


def test_default_partition_blocks(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df.repartition(3), n_blocks=2, rho="auto")
    f = admm.fit(prob, 5.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    assert np.allclose(f.coef, cd_lasso(X, y, 5.0), atol=1e-6)


def test_lambda_above_max_gives_zeros(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(2)), rho="auto")
    lmax = admm.lambda_max(prob)
    assert np.isclose(lmax, np.abs(X.T @ y).max())
    f = admm.fit(prob, lmax * 1.01, max_iter=2000)
    assert f.converged and f.nnz() == 0


def test_warm_start_continues(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(2)), rho="auto")
    f1 = admm.fit(prob, 3.0, max_iter=4, abs_tol=1e-10, rel_tol=1e-10)
    assert f1.iterations == 4 and not f1.converged
    f2 = admm.fit(prob, 3.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10, init=f1.state)
    cold = admm.fit(prob, 3.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    assert np.allclose(f2.coef, cold.coef, atol=1e-7)
    # the resumed run continues the same iterate sequence
    assert f1.iterations + f2.iterations == cold.iterations


def test_rho_change_refactors(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(2)), rho=1.0)
    f1 = admm.fit(prob, 3.0, max_iter=10)
    prob2 = prob.with_rho(5.0)
    f2 = admm.fit(prob2, 3.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10, init=f1.state)
    assert np.allclose(f2.coef, cd_lasso(X, y, 3.0), atol=1e-6)


def test_lambda_grid_picks_min_mse(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(2)), rho="auto")
    g = tune.lambda_grid(prob, [50.0, 5.0, 0.5], max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    rows = sorted(g.results.collect(), key=lambda r: r["pos"])
    for r in rows:
        b = cd_lasso(X, y, r["lambda"])
        assert np.isclose(r["mse"], np.mean((X @ b - y) ** 2), atol=1e-8)
    assert g.best_pos == 2
    best = tune.best_lambda(g.results).first()
    assert best["best_lambda"] == 0.5
    seq = tune.lambda_grid(prob, [50.0, 5.0, 0.5], warm_start=True, max_iter=5000,
                           abs_tol=1e-10, rel_tol=1e-10)
    for a, b in zip(g.fits, seq.fits):
        assert np.allclose(a.coef, b.coef, atol=1e-7)


def test_fit_many_matches_single_fits(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(3)), rho="auto")
    many = admm.fit_many(prob, [20.0, 1.0, 5.0], max_iter=5000, abs_tol=1e-9, rel_tol=1e-9)
    for f in many:
        one = admm.fit(prob, f.lam, max_iter=5000, abs_tol=1e-9, rel_tol=1e-9)
        # same iterate sequence up to BLAS rounding (matrix-matrix vs matrix-vector)
        assert one.iterations == f.iterations
        assert np.allclose(one.coef, f.coef, atol=1e-9)
        assert len(one.history_rows) == len(f.history_rows)
        assert np.allclose([r[5] for r in one.history_rows], [r[5] for r in f.history_rows])
    # a frozen fit resumes exactly like a single fit's state
    f2 = admm.fit(prob, 1.0, max_iter=3, init=many[1].state)
    assert f2.iterations == 1 and f2.converged


GOLDEN = {0.128: 0.77781616, 0.5: 1.16073114, 1.0: 1.65430871, 5.0: 5.12633990}


@pytest.mark.skipif(not (SAMPLE_GENO and os.path.exists(SAMPLE_GENO)),
                    reason="set SPARSELM_SAMPLE_GENO / SPARSELM_SAMPLE_PHENO")
def test_golden_objectives_on_sample_files(spark):
    geno = text.read_sample_major(spark, SAMPLE_GENO)
    pheno = text.read_traits(spark, SAMPLE_PHENO)
    data = align.design(align.join_samples(geno, pheno))
    assert data.count() == 19
    for blocks, lams in ((1, [0.5]), (4, list(GOLDEN))):
        prob = admm.prepare(data, block_col=F.pmod(F.xxhash64("sample_id"), F.lit(blocks)),
                            rho="auto", names=geno.names)
        for lam in lams:
            f = admm.fit(prob, lam, max_iter=20000, abs_tol=1e-8, rel_tol=1e-8)
            assert abs(f.objective() - GOLDEN[lam]) < 1e-6, (blocks, lam, f.objective())
    # every λ above max|Aᵀb| gives all zeros
    assert np.isclose(admm.lambda_max(prob), 19.49214815)


def test_resume_after_caches_are_lost(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(2)), rho="auto")
    f1 = admm.fit(prob, 3.0, max_iter=12, abs_tol=1e-10, rel_tol=1e-10)
    # drop every cached frame (as if the executors holding them were lost):
    # the block statistics and the fit state come back from the checkpoints
    spark.catalog.clearCache()
    f2 = admm.fit(prob, 3.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10, init=f1.state)
    cold = admm.fit(prob, 3.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    assert f1.iterations + f2.iterations == cold.iterations
    assert np.allclose(f2.coef, cd_lasso(X, y, 3.0), atol=1e-6)


def test_fat_blocks_match_dense(spark):
    rng = np.random.default_rng(5)
    n, p = 64, 90                       # wider than any block
    X = rng.normal(size=(n, p))
    beta = np.zeros(p)
    beta[[0, 7, 33]] = [2.0, -1.0, 0.5]
    y = X @ beta + 0.05 * rng.normal(size=n)
    df = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(n)],
                               "sample_id long, features array<double>, label double")
    blocks = F.floor(F.col("sample_id") / 16)
    dense = admm.prepare(df, block_col=blocks, rho="auto")
    fat = admm.prepare(df, block_col=blocks, rho=dense.rho, mode="fat")
    assert fat.fat and fat.n_blocks == dense.n_blocks == 4
    fd = admm.fit(dense, 2.0, max_iter=3000, abs_tol=1e-9, rel_tol=1e-9)
    ff = admm.fit(fat, 2.0, max_iter=3000, abs_tol=1e-9, rel_tol=1e-9)
    # the matrix inversion lemma gives the same iterates as the p×p factor
    assert ff.iterations == fd.iterations
    assert np.allclose(ff.coef, fd.coef, atol=1e-8)
    ref = cd_lasso(X, y, 2.0)
    assert abs(ff.objective() - obj(X, y, ref, 2.0)) < 1e-5
    kkt = admm.gradient_check(fat, ff.coef, 2.0, 1e-3).collect()
    assert len(kkt) == p and all(r["kkt_ok"] for r in kkt)
    # default fat blocks: runs of at most rows_per_block rows of a task
    auto = admm.prepare(df.repartition(2), rho="auto", mode="fat", rows_per_block=10)
    sizes = [r["ni"] for r in auto.blocks.select("ni").collect()]
    assert sum(sizes) == n and max(sizes) <= 10


def test_mode_auto_and_fat_block_size_check(spark):
    df, X, y = _random(spark)
    assert not admm.prepare(df, rho="auto", mode="auto").fat          # p = 6: dense
    old = admm.DENSE_MAX_FEATURES
    admm.DENSE_MAX_FEATURES = 4
    try:
        assert admm.prepare(df, rho="auto", mode="auto", rows_per_block=32).fat
    finally:
        admm.DENSE_MAX_FEATURES = old
    # a block chosen by the caller that is larger than a fat block is split
    prob = admm.prepare(df, block_col=F.lit(0), rho="auto", mode="fat", rows_per_block=10)
    sizes = [r["ni"] for r in prob.blocks.select("ni").collect()]
    assert prob.n == len(y) and max(sizes) <= 10 and len(sizes) == 12
    assert np.allclose(prob.xty, X.T @ y)


def test_fat_blocks_expand_pairs_in_the_scan(spark):
    df, X, y = _random(spark)
    k, j = np.triu_indices(X.shape[1], 1)
    wide = np.concatenate([X, X[:, k] * X[:, j]], axis=1)
    stats = admm.fat_block_statistics(df.repartition(3), rows_per_block=7, pairs=True)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1                      # the test's own repartition
    prob = admm.prepare(df.repartition(3), mode="fat", rows_per_block=7, pairs=True, rho="auto")
    assert prob.p == wide.shape[1] and prob.n == len(y)
    assert np.allclose(prob.xty, wide.T @ y)
    f = admm.fit(prob, 5.0, max_iter=5000, abs_tol=1e-9, rel_tol=1e-9)
    assert abs(f.objective() - obj(wide, y, cd_lasso(wide, y, 5.0), 5.0)) < 1e-4


def test_asked_blocks_do_not_depend_on_partitioning(spark):
    df, X, y = _random(spark)
    coefs = []
    for parts in (1, 2, 4):
        prob = admm.prepare(df.repartition(parts), n_blocks=4, rho=1.0)
        assert prob.n_blocks == 4
        coefs.append(admm.fit(prob, 2.0, max_iter=5).coef)
    assert np.allclose(coefs[0], coefs[1], atol=1e-12)
    assert np.allclose(coefs[0], coefs[2], atol=1e-12)


def test_names_of_another_length_are_rejected(spark):
    df, X, y = _random(spark)
    names = spark.createDataFrame([(0, "a")], "idx int, name string")
    with pytest.raises(ValueError, match="names"):
        admm.prepare(df, names=names)


def test_superseded_iterates_are_deleted(spark):
    import glob

    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(3)), rho="auto")
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    before = set(glob.glob(f"{base}/rdd-*"))
    admm.fit(prob, 3.0, max_iter=20, abs_tol=0.0, rel_tol=0.0, checkpoint_every=4)
    assert len(set(glob.glob(f"{base}/rdd-*")) - before) == 1        # the final state


def test_replayed_rounds_are_the_same_rounds(spark):
    """The iterates do not depend on how often they are written."""
    df, X, y = _random(spark)
    prob = admm.prepare(df, block_col=F.pmod("sample_id", F.lit(3)), rho="auto")
    ref = admm.fit(prob, 3.0, max_iter=12, abs_tol=1e-10, rel_tol=1e-10, checkpoint_every=2)
    for every in (5, 0):
        f = admm.fit(prob, 3.0, max_iter=12, abs_tol=1e-10, rel_tol=1e-10,
                     checkpoint_every=every)
        assert f.iterations == ref.iterations
        assert np.array_equal(f.coef, ref.coef)
    seconds = [r["seconds"] for r in ref.timings().collect()]
    assert len(seconds) >= ref.iterations and min(seconds) > 0 and sum(seconds) <= ref.seconds


def test_a_round_moves_neither_factors_nor_iterates(spark):
    """After iterates are placed, the only exchanges of a round are of sums."""
    df, X, y = _random(spark)
    prob = admm.prepare(df, n_blocks=5, rho=1.0)
    zero = F.array_repeat(F.lit(0.0), prob.p)
    held = prob.factors.select("block_id", *[zero.alias(c) for c in admm._STATE]).repartition(
        prob.partitions, "block_id").persist()
    held.count()
    joined = prob.factors.join(held.hint("shuffle_hash"), "block_id").select(
        "block_id", "b", "s", "q0", *admm._STATE)
    rounds = [(np.zeros((1, prob.p)), np.ones(1, bool), True)]
    step = joined.mapInArrow(admm._replay_fn(rounds, 1.0, prob.p, False, True), admm._SUM_SCHEMA)
    plan = step._jdf.queryExecution().executedPlan().toString()
    above = plan.split("InMemoryRelation")[0]
    assert "ShuffledHashJoin" in above and "Exchange" not in above
    assert "ENSURE_REQUIREMENTS" not in plan
    assert step.columns == ["v", "nb"]
    held.unpersist()


@pytest.mark.parametrize("parts", [1, 5, 70, 300])
def test_sums_are_added_in_levels(spark, parts):
    from sparselm.operators import reduction

    v = spark.range(parts, numPartitions=parts).select(
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), F.lit(2).cast("long").alias("nb"))
    total, n = reduction.added(v, parts)
    assert (list(total), n) == ([parts * (parts - 1) / 2, float(parts)], 2 * parts)


def test_one_decomposition_serves_every_rho(spark):
    df, X, y = _random(spark)
    prob = admm.prepare(df, rho="auto", n_blocks=3)
    other = prob.with_rho(2 * prob.rho)
    assert other.factors is prob.factors and other.rho == 2 * prob.rho
    a = admm.fit(prob, 3.0, max_iter=200, abs_tol=1e-5, rel_tol=1e-5)
    b = admm.fit(other, 3.0, max_iter=200, abs_tol=1e-5, rel_tol=1e-5, init=a.state)
    assert a.converged and b.converged and b.iterations < a.iterations
    assert np.allclose(a.coef, b.coef, atol=1e-2)
    A = np.random.Generator(np.random.PCG64(1)).standard_normal((9, 6))
    for rho in (0.1, 30.0):
        for M, fat in ((A, True), (A[:4], True), (A.T @ A, False)):
            B, s = admm.eigen_rows(M) if fat else admm.eigen_factor(M)
            G = M.T @ M if fat else M
            q = np.arange(6.0)
            x = admm._solve(B[None], s[None, None], q[None, None], rho, fat)[0, 0]
            assert np.allclose((G + rho * np.eye(6)) @ x, q)


def test_default_blocks_do_not_follow_the_partitioning(spark):
    df, X, y = _random(spark)
    fits = []
    for parts in (1, 2, 4):
        prob = admm.prepare(df.repartition(parts))
        assert prob.n_blocks == admm.DEFAULT_BLOCKS
        fits.append(admm.fit(prob, 2.0, max_iter=5))
    rows = [f.history().select("iter", "resid_primal", "resid_dual").collect() for f in fits]
    assert len(rows[0]) == 5
    for f, r in zip(fits[1:], rows[1:]):
        assert np.allclose(f.coef, fits[0].coef, atol=1e-12)
        assert np.allclose(np.array(r, dtype=float), np.array(rows[0], dtype=float), atol=1e-9)


def test_a_hot_block_key_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(admm, "_HOT_BLOCKS", 2)
    df = spark.range(400).select(
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"),
        (F.col("id") % 7).cast("double").alias("label"),
        F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 5).alias("k"))
    stats = admm.fat_block_statistics(df, rows_per_block=10, block_col="k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = stats.select("block_id", "ni", F.element_at("q0", 2).alias("y")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["ni"] for r in rows) == 400 and max(r["ni"] for r in rows) <= 10
    assert sum(r["y"] for r in rows) == sum(i % 7 for i in range(400))
    tasks = {r["block_id"] >> 31 for r in rows}
    assert len(tasks) > 4


def test_pair_blocks_hold_the_features_only(spark, monkeypatch):
    """A block of pair products does not hold them: the cells of blocks and factors
    are those of the features, and partitions are as many as the bytes fill."""
    df, X, y = _random(spark)
    stats = admm.fat_block_statistics(df.coalesce(1), rows_per_block=7, pairs=True)
    rows = stats.select(F.size("a").alias("a"), "ni", F.size("q0").alias("p")).collect()
    assert [(r["a"], r["p"]) for r in rows] == [(r["ni"] * 6, 21) for r in rows]
    prob = admm.prepare(df.coalesce(1), mode="fat", rows_per_block=7, pairs=True, rho="auto")
    cells = prob.factors.select(*prob.cells).drop("block_id", "q0").first()
    assert sum(len(c) for c in cells) <= 7 * 6
    wide = spark.sparkContext.defaultParallelism
    assert prob.partitions <= 4 * wide
    # each of the 18 blocks of 504 bytes fills a partition
    monkeypatch.setattr(admm, "FACTOR_PART_BYTES", 400)
    assert admm._partitions_for(prob.blocks, 18, 2, 504) == 18
    assert admm._partitions_for(prob.blocks, 10 ** 5, 2, 504) == 10 ** 5
    assert admm._partitions_for(prob.blocks, 10 ** 5, 2, 0.001) == 8


def test_pair_blocks_fit_like_formed_products(spark):
    """The same rounds, states, checks and paths as with the products as columns."""
    from sparselm.operators import tune

    df, X, y = _random(spark)
    k, j = np.triu_indices(X.shape[1], 1)
    A = np.concatenate([X, X[:, k] * X[:, j]], axis=1)
    wide = spark.createDataFrame([(i, A[i].tolist(), float(y[i])) for i in range(len(y))],
                                 "sample_id long, features array<double>, label double")
    by = F.floor(F.col("sample_id") / 12)           # ten blocks: no summed start
    a, b = (admm.prepare(d, block_col=by, mode="fat", rho="auto", pairs=q)
            for d, q in ((df, True), (wide, False)))
    assert a.n_blocks == b.n_blocks == 10 and abs(a.trace - b.trace) < 1e-9 * b.trace
    assert a.rho == pytest.approx(b.rho) and np.allclose(a.xty, A.T @ y)
    kw = {"abs_tol": 1e-6, "rel_tol": 1e-6}
    for every in (0, 3):
        fa, fb = (admm.fit_many(q, (4.0, 40.0), max_iter=7, checkpoint_every=every, **kw)
                  for q in (a, b))
        for ga, gb in zip(fa, fb):
            assert ga.iterations == gb.iterations and np.allclose(ga.coef, gb.coef, atol=1e-9)
            assert np.allclose(np.array(ga.history_rows), np.array(gb.history_rows), rtol=1e-6)
    # another ρ, from a saved state
    ra, rb = (admm.fit(q.with_rho(2 * q.rho), 4.0, max_iter=5, init=f[0].state, **kw)
              for q, f in ((a, fa), (b, fb)))
    assert np.allclose(ra.coef, rb.coef, atol=1e-9)
    ga, gb = (admm.gradient_check(q, ra.coef, 4.0).orderBy("idx").collect() for q in (a, b))
    assert np.allclose([r["grad"] for r in ga], [r["grad"] for r in gb])
    assert np.allclose(admm._zgz_many(a, np.stack([ra.coef, y[:21]])),
                       admm._zgz_many(b, np.stack([ra.coef, y[:21]])))
    pa_, pb = (tune.strong_path(q, [30.0, 6.0]) for q in (a, b))
    assert np.allclose(pa_.coefs, pb.coefs, atol=1e-6)


def test_a_summed_start_of_pair_blocks_is_confirmed(spark):
    df, X, y = _random(spark)
    k, j = np.triu_indices(X.shape[1], 1)
    A = np.concatenate([X, X[:, k] * X[:, j]], axis=1)
    prob = admm.prepare(df.coalesce(1), mode="fat", rows_per_block=5, pairs=True, rho="auto")
    assert prob.n_blocks >= admm.SUMMED_START_BLOCKS
    f = admm.fit(prob, 5.0, max_iter=1000, abs_tol=1e-8, rel_tol=1e-8)
    assert f.converged and f.iterations <= 3
    assert np.allclose(f.coef, cd_lasso(A, y, 5.0), atol=1e-5)
    # and goes on from its state
    again = admm.fit(prob, 5.0, max_iter=1000, abs_tol=1e-8, rel_tol=1e-8, init=f.state)
    assert again.converged and np.allclose(again.coef, f.coef, atol=1e-7)
