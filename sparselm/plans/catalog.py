"""Registered queries over the driver's test tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables:

* ``embeddings`` (``vec_id``, 64-dim ``embedding``, ``label``) is the sample
  matrix: ``sample_id = vec_id``, ``features = embedding`` as doubles,
  ``label`` the response; ``labels`` (``doc_id``, ``quality``, ``toxic``)
  is the trait table, keyed by ``doc_id``.
* ``orders`` one-hot encoded by ``o_orderpriority`` with response
  ``o_totalprice/1000 − 250`` gives a design whose Gram matrix is diagonal,
  so the LASSO optimum has a closed form a SQL engine can check:
  ``coef_g = S(Σ_g y, λ) / n_g``.
* ``lineitem`` grouped by return flag / line status feeds the grouped ridge
  solve.

Values computed by floating-point reductions are rounded (6 decimals for
aggregates, 4 for converged fits) so that summation order does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import soft_threshold
from ..operators import admm, align, features, model, moments, sharing, tune
from ..session import scratch_path, written
from ..sources import text
from ..sources.text import LabeledMatrix, MarkerMajor
from . import jobs

# fixed parameters of the registered queries
DROP_POSITIONS = [0, 31, 63]
EMB_BLOCKS = 4
EMB_LAMBDA = 5.0
ONEHOT_LAMBDA = 8000.0
ONEHOT_CENTER = 250.0
GRID = [8000.0, 2000.0, 0.0, 20000.0]      # the best one is not the first
STEP_LAMBDA = 8.0
THRESHOLD = 20.0
FIT_TOL = 1e-10
HISTORY_TOL = 1e-4
LINEITEM_BLOCKS = 4
JOB_LAMBDA = 1.0
LINEITEM_LAMBDA = 3000.0
WIDE_LAMBDA = 20.0
WIDE_ROWS_PER_BLOCK = 128
JOB_ROWS_PER_BLOCK = 32     # fewer than the 64 features
LINEITEM_CENTER = 53.0
RHO_FACTOR = 3.0
FOLDS = 5
COLUMN_BLOCKS = 6
FILE_SAMPLES = 1000        # of one folder of marker-major files, about


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


# ---------------------------------------------------------------- inputs


def emb_matrix(spark: SparkSession, d: str) -> LabeledMatrix:
    e = _t(spark, d, "embeddings")
    df = e.select(F.col("vec_id").alias("sample_id"),
                  F.transform("embedding", lambda v: v.cast("double")).alias("features"),
                  F.col("label").cast("double").alias("label"))
    names = (e.agg(F.max(F.size("embedding")).alias("p"))
             .select(F.posexplode(F.sequence(F.lit(0), F.col("p") - 1)).alias("idx", "k"))
             .select(F.col("idx").cast("int"), F.concat(F.lit("e"), F.col("k").cast("string"))
                     .alias("name")))
    return LabeledMatrix(df, names, "features")


def label_traits(spark: SparkSession, d: str) -> LabeledMatrix:
    lab = _t(spark, d, "labels")
    df = lab.select(F.col("doc_id").alias("sample_id"),
                    F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
                    .alias("traits"))
    names = spark.createDataFrame([(0, "quality"), (1, "toxic")], "idx int, name string")
    return LabeledMatrix(df, names, "traits")


def onehot_orders(spark: SparkSession, d: str):
    """(design DataFrame, names list) for the closed-form checks."""
    o = _t(spark, d, "orders")
    # category levels: bounded by the number of distinct priorities
    levels = sorted(r[0] for r in o.select("o_orderpriority").distinct().collect())
    feats = F.array(*[F.when(F.col("o_orderpriority") == lv, F.lit(1.0)).otherwise(F.lit(0.0))
                      for lv in levels])
    df = o.select("o_orderkey", feats.alias("features"),
                  (F.col("o_totalprice") / 1000 - ONEHOT_CENTER).alias("label"))
    names = [f"o_orderpriority={lv}" for lv in levels]
    return df, names


def _names_df(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


def onehot_problem(spark: SparkSession, d: str, rho="auto"):
    df, names = onehot_orders(spark, d)
    prob = admm.prepare(df, block_col=F.pmod(F.col("o_orderkey"), F.lit(4)), rho=rho,
                        names=_names_df(spark, names))
    return prob, names, df


def onehot_fit(spark: SparkSession, d: str, lam: float = ONEHOT_LAMBDA):
    prob, names, df = onehot_problem(spark, d)
    f = admm.fit(prob, lam, max_iter=5000, abs_tol=FIT_TOL, rel_tol=FIT_TOL)
    return f, names, df


# ---------------------------------------------------------------- scans


def q_sample_matrix_long(spark, d):
    """Render embeddings as sample-major TSV, scan it back."""
    m = emb_matrix(spark, d)
    lines = text.format_sample_major(m.df, "features", m.names)
    parsed = text.parse_sample_major(lines)
    return parsed.long().select("sample_id", F.col("idx").cast("int"), "value")


def q_feature_dictionary(spark, d):
    m = emb_matrix(spark, d)
    lines = text.format_sample_major(m.df, "features", m.names)
    return text.parse_sample_major(lines).names


def _combined_files(spark, d):
    """Combined matrix of embeddings and labels, written with its header."""
    m = emb_matrix(spark, d)
    tr = label_traits(spark, d)
    p = m.width()
    rows, _ = written(spark, features.combined_rows(m.df.select("sample_id", "features"), tr.df,
                                                    p).select("value"), "combined-rows")
    names = [r["name"] for r in features.interactions(m, p).names.orderBy("idx").collect()]
    path = scratch_path(spark, "combined")
    text.write_combined(rows, path, 2, names, rows.count())
    return text.read_combined(spark, path)


def q_combined_scan(spark, d):
    """Combined-matrix files with two header lines, scanned back; the
    declared counts are checked."""
    parsed = _combined_files(spark, d)
    parsed.check_rows(parsed.df.count())
    return parsed.df.select(
        F.element_at("traits", 1).alias("quality"), F.element_at("traits", 2).alias("toxic"),
        F.size("features").alias("n_features"),
        r6(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("feature_sum"))


def q_combined_names(spark, d):
    """The names line of the combined matrix."""
    return _combined_files(spark, d).names


def _marker_major_files(spark, m: LabeledMatrix, base: str) -> list[str]:
    """The matrix written as marker-major files in blocks of some ``FILE_SAMPLES``
    samples, a folder each; a header line and a marker's line hold one block."""
    df, _ = written(spark, m.df.select("sample_id", "features"), "marker-major-source")
    n = max(1, -(-df.count() // FILE_SAMPLES))
    df = df.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(n)))
    # one line of a block's sample names, before those of its markers
    heads = df.groupBy("part").agg(F.array_sort(F.collect_list("sample_id")).alias("ids")).select(
        "part", F.lit(-1).alias("idx"), F.concat_ws(
            text.TAB, F.lit("rs"), F.lit("alleles"), F.lit("chrom"), F.lit("pos"), F.lit("strand"),
            F.transform("ids", lambda v: v.cast("string"))).alias("value"))
    cells = df.select("part", "sample_id", F.posexplode("features").alias("idx", "value")) \
        .groupBy("part", "idx").agg(F.array_sort(F.collect_list(
            F.struct("sample_id", "value"))).alias("cells")).join(m.names, "idx")
    lines = cells.select("part", "idx", F.concat_ws(
        text.TAB, "name", F.lit("A/C"), F.lit("1"), F.col("idx").cast("string"), F.lit("+"),
        F.concat_ws(text.TAB, F.transform("cells", lambda c: c["value"].cast("string"))))
        .alias("value"))
    # a block's lines are one task's and one file's; all folders in one job
    heads.union(lines).repartition("part").sortWithinPartitions("part", "idx").select(
        "part", "value").write.partitionBy("part").text(f"{base}/geno")
    found = [r["part"] for r in df.select("part").distinct().collect()]
    return [f"{base}/geno/part={k}" for k in sorted(found)]


def q_interaction_files(spark, d):
    """The embeddings written as marker-major files in blocks of
    samples, the labels as a trait table, the interaction job over both, its
    output scanned back."""
    m = emb_matrix(spark, d)
    tr = label_traits(spark, d)
    base = scratch_path(spark, "interaction-job")
    geno = _marker_major_files(spark, m, base)
    text.write_sample_major(tr.df, "traits", tr.names, f"{base}/pheno", id_label="id")
    jobs.interaction_job(spark, geno, f"{base}/pheno", f"{base}/out", header=True)
    back = text.read_combined(spark, f"{base}/out")
    back.check_rows(back.df.count())
    first = F.element_at("features", 1)
    return back.df.select(
        F.element_at("traits", 1).alias("quality"), F.element_at("traits", 2).alias("toxic"),
        F.size("features").alias("n_features"), first.alias("first_marker"),
        F.element_at("features", -1).alias("last_product"),
        r6(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("feature_sum"))


# ---------------------------------------------------------------- joins


def q_sample_join(spark, d):
    """Inner join on sample id, response = first trait."""
    m = emb_matrix(spark, d)
    tr = label_traits(spark, d)
    j = align.design(align.join_samples(m.df.drop("label"), tr), trait=0)
    return j.select("sample_id", F.col("label").alias("y"),
                    F.size("features").alias("n_features"),
                    r6(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("feature_sum"))


def q_alignment_report(spark, d):
    """Rows dropped or multiplied by the join."""
    return align.alignment_report(emb_matrix(spark, d).df, label_traits(spark, d).df)


def q_positional_join(spark, d):
    """I-th sample (by vec_id) with i-th trait row (by doc_id)."""
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    lab = _t(spark, d, "labels").select("doc_id", "quality")
    return align.positional_join(e, lab, ["vec_id"], ["doc_id"], "pos") \
        .select("pos", "vec_id", "label", "doc_id", "quality")


# ---------------------------------------------------------------- reshaping


def q_drop_features(spark, d):
    """Remove feature positions, re-index the rest."""
    m = features.drop_features(emb_matrix(spark, d), DROP_POSITIONS)
    return m.long().select("sample_id", F.col("idx").cast("int"), "value")


def q_transpose(spark, d):
    """Marker-major long form → sample-major rows."""
    long = (_t(spark, d, "embeddings")
            .select(F.col("vec_id").alias("sample_idx"),
                    F.posexplode("embedding").alias("marker_idx", "v"))
            .select(F.col("marker_idx").cast("int"), "sample_idx",
                    F.col("v").cast("double").alias("value")))
    markers = emb_matrix(spark, d).names.select(F.col("idx").alias("marker_idx"),
                                                F.col("name").alias("marker"))
    samples = _t(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_idx"), F.col("vec_id").cast("string").alias("sample_id"))
    m = features.transpose_long(MarkerMajor(long, markers, samples))
    return m.long().select("sample_id", F.col("idx").cast("int"), "value")


def q_pairwise_interactions(spark, d):
    """Every product x_k·x_j, k<j, per sample."""
    m = emb_matrix(spark, d)
    return features.interactions_long(m, m.width())


def q_interaction_names(spark, d):
    m = emb_matrix(spark, d)
    m = features.interactions(m, m.width())
    return m.names


# ---------------------------------------------------------------- aggregates


def _emb_moments(spark, d, blocks: bool = False):
    m = emb_matrix(spark, d).df
    if blocks:
        m = m.withColumn("block_id", F.pmod(F.col("sample_id"), F.lit(EMB_BLOCKS)))
        return moments.moments(m, keys=["block_id"])
    return moments.moments(m)


def q_gram(spark, d):
    g = moments.gram(_emb_moments(spark, d))
    return g.select("i", "j", r6(F.col("g")).alias("g"))


def q_xty(spark, d):
    return moments.xty(_emb_moments(spark, d)).select("i", r6(F.col("xty")).alias("xty"))


def q_block_moments(spark, d):
    g = moments.gram(_emb_moments(spark, d, True), keys=["block_id"])
    return g.select("block_id", "i", "j", r6(F.col("g")).alias("g"))


def q_block_sq_norms(spark, d):
    b = moments.block_sq_norms(_emb_moments(spark, d, True), keys=["block_id"])
    return b.select("block_id", r6(F.col("sq_norm")).alias("sq_norm"), "n")


def q_vector_mean(spark, d):
    return moments.column_means(_emb_moments(spark, d)).select("i", r6(F.col("mean")).alias("mean"))


def q_soft_threshold(spark, d):
    x = moments.xty(_emb_moments(spark, d))
    return x.select("i", r6(soft_threshold(F.col("xty"), THRESHOLD)).alias("value"))


def q_ridge_solve_p2(spark, d):
    li = _t(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus",
        F.array("l_quantity", "l_discount").alias("features"),
        (F.col("l_extendedprice") / 1000).alias("label"))
    r = moments.ridge_solve(li, ["l_returnflag", "l_linestatus"], rho=1.0)
    return r.select("l_returnflag", "l_linestatus", "i", r4(F.col("x")).alias("x"))


# ---------------------------------------------------------------- fits


def q_lasso_onehot(spark, d):
    """Converged fit, non-zero coefficients with names."""
    f, names, _ = onehot_fit(spark, d)
    return model.nonzero_coefficients(f.coefficients()).select(
        "idx", "name", r4(F.col("coef")).alias("coef"))


def q_lasso_lineitem(spark, d):
    """M11/M19 on the largest table: one-hot (return flag, line status) design,
    four hash blocks, all coefficients."""
    li = _t(spark, d, "lineitem")
    levels = sorted((r[0], r[1]) for r in
                    li.select("l_returnflag", "l_linestatus").distinct().collect())
    feats = F.array(*[F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b),
                             F.lit(1.0)).otherwise(F.lit(0.0)) for a, b in levels])
    df = li.select(feats.alias("features"),
                   (F.col("l_extendedprice") / 1000 - LINEITEM_CENTER).alias("label"))
    names = _names_df(spark, [f"{a}{b}" for a, b in levels])
    prob = admm.prepare(df, n_blocks=LINEITEM_BLOCKS, rho="auto", names=names)
    f = admm.fit(prob, LINEITEM_LAMBDA, max_iter=5000, abs_tol=FIT_TOL, rel_tol=FIT_TOL)
    return f.coefficients().select("idx", "name", r4(F.col("coef")).alias("coef"),
                                   F.lit(prob.n_blocks).alias("n_blocks"),
                                   F.lit(prob.n).cast("long").alias("n"))


def q_admm_step(spark, d):
    """M1/M2/M4/M5: one ADMM round from zero, ρ=1, four blocks."""
    prob, names, _ = onehot_problem(spark, d, rho=1.0)
    f = admm.fit(prob, STEP_LAMBDA, max_iter=1)
    return f.coefficients().select("idx", r6(F.col("coef")).alias("z"))


def q_admm_three_rounds(spark, d):
    """Three ADMM rounds from zero (ρ=1, four blocks) — checks the
    u-update carried between rounds."""
    prob, names, _ = onehot_problem(spark, d, rho=1.0)
    f = admm.fit(prob, STEP_LAMBDA, max_iter=3)
    return f.coefficients().select("idx", r6(F.col("coef")).alias("z"))


def q_history_two_rounds(spark, d):
    """Residuals, tolerances and objective of the first two rounds."""
    prob, names, _ = onehot_problem(spark, d, rho=1.0)
    f = admm.fit(prob, STEP_LAMBDA, max_iter=2)
    return f.history().select("iter", r6(F.col("resid_primal")).alias("resid_primal"),
                              r6(F.col("resid_dual")).alias("resid_dual"),
                              F.round("eps_primal", 8).alias("eps_primal"),
                              F.round("eps_dual", 8).alias("eps_dual"),
                              F.round(F.col("objective"), 2).alias("objective"))


def q_admm_history(spark, d):
    """Every round up to the stop test's, automatic ρ."""
    prob, _, _ = onehot_problem(spark, d)
    f = admm.fit(prob, ONEHOT_LAMBDA, max_iter=200, abs_tol=HISTORY_TOL, rel_tol=HISTORY_TOL)
    return _logged(f)


def q_warm_start(spark, d):
    """5 rounds, then resume from the saved state to convergence."""
    prob, names, _ = onehot_problem(spark, d)
    f1 = admm.fit(prob, ONEHOT_LAMBDA, max_iter=5, abs_tol=FIT_TOL, rel_tol=FIT_TOL)
    f2 = admm.fit(prob, ONEHOT_LAMBDA, max_iter=5000, abs_tol=FIT_TOL, rel_tol=FIT_TOL,
                  init=f1.state)
    return f2.coefficients().select("idx", r4(F.col("coef")).alias("coef"))


def q_final_state(spark, d):
    """Consensus z and the block means x̄ and ū at convergence."""
    f, _, _ = onehot_fit(spark, d)
    return f.final_state().select("idx", "name", r4(F.col("z")).alias("z"),
                                  r4(F.col("xbar")).alias("xbar"),
                                  r4(F.col("ubar")).alias("ubar"))


def _logged(f):
    return f.history().select("iter", *[r4(F.col(c)).alias(c) for c in (
        "resid_primal", "eps_primal", "resid_dual", "eps_dual")],
        F.round("objective", 1).alias("objective"), F.lit(f.iterations).alias("iterations"),
        F.lit(f.converged).alias("converged"))


def q_fit_history(spark, d):
    """Per-iteration residuals, tolerances and objective of the whole fit."""
    f, _, _ = onehot_fit(spark, d)
    return _logged(f)


def q_round_timings(spark, d):
    """One positive time per round, together within the fit's time."""
    prob, _, _ = onehot_problem(spark, d)
    f = admm.fit(prob, ONEHOT_LAMBDA, max_iter=200, abs_tol=HISTORY_TOL, rel_tol=HISTORY_TOL)
    return f.timings().agg(F.count("*").cast("int").alias("rounds"),
                           (F.min("seconds") > 0).alias("positive"),
                           (F.sum("seconds") <= f.seconds).alias("within_fit"))


def q_lasso_two_rho(spark, d):
    """One decomposition answers two ρ; the second fit starts from the
    state of the first."""
    prob, _, _ = onehot_problem(spark, d)
    other = prob.with_rho(RHO_FACTOR * prob.rho)
    assert other.factors is prob.factors
    kw = {"max_iter": 5000, "abs_tol": FIT_TOL, "rel_tol": FIT_TOL}
    f = admm.fit(prob, ONEHOT_LAMBDA, **kw)
    g = admm.fit(other, ONEHOT_LAMBDA, init=f.state, **kw)
    return f.coefficients().select(F.lit(0).alias("fit"), "idx", r4(F.col("coef")).alias("coef")) \
        .union(g.coefficients().select(F.lit(1), "idx", r4(F.col("coef"))))


def q_cross_validation(spark, d):
    """Held-out error of every fold and λ, one scan for all folds."""
    df, _ = onehot_orders(spark, d)
    res = tune.cross_validate(df, GRID, fold_col=F.pmod(F.col("o_orderkey"), F.lit(FOLDS)))
    best = tune.cross_validated_best(res)
    return res.join(best.select("pos", F.col("mse").alias("mse_all"), "best"), "pos").select(
        "fold", "pos", "lambda", "n", r4(F.col("mse")).alias("mse"), "nnz",
        r4(F.col("mse_all")).alias("mse_all"), "best")


def q_strong_path(spark, d):
    """Descending path on screened features, repaired by the gradient."""
    prob, _, _ = onehot_problem(spark, d)
    res = tune.strong_path(prob, GRID)
    z = spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(res.coefs)
                               for i, v in enumerate(row)], "pos int, idx int, coef double")
    return z.join(res.results, "pos").select(
        "pos", "lambda", "screened", "nnz", r4(F.col("mse")).alias("mse"), "idx",
        r4(F.col("coef")).alias("coef"))


def q_lasso_embeddings(spark, d):
    """M11/M19 on a dense design: optimality (KKT) of every coefficient."""
    m = emb_matrix(spark, d)
    prob = admm.prepare(m.df, block_col=F.pmod(F.col("sample_id"), F.lit(EMB_BLOCKS)),
                        rho="auto", names=m.names)
    f = admm.fit(prob, EMB_LAMBDA, max_iter=5000, abs_tol=1e-9, rel_tol=1e-9)
    return _optimality(spark, prob, f, EMB_LAMBDA, 1e-4 * EMB_LAMBDA)


def _optimality(spark, prob, f, lam, tol):
    """KKT flag per coefficient next to what the block building kept of the
    data: Aᵀb and the row count."""
    xty = spark.createDataFrame([(i, float(v)) for i, v in enumerate(prob.xty)],
                                "idx int, xty double")
    return admm.gradient_check(prob, f.coef, lam, tol).join(xty, "idx").select(
        "idx", "kkt_ok", r4(F.col("xty")).alias("xty"), F.lit(prob.n).cast("long").alias("n"))


def _job_files(spark, d, name, **kw):
    m = emb_matrix(spark, d)
    tr = label_traits(spark, d)
    base = scratch_path(spark, name)
    text.write_sample_major(m.df, "features", m.names, f"{base}/geno")
    text.write_sample_major(tr.df, "traits", tr.names, f"{base}/pheno", id_label="id")
    res = jobs.lasso_job(spark, f"{base}/geno", f"{base}/pheno", out=f"{base}/out",
                         lam=JOB_LAMBDA, rho="auto", abs_tol=1e-9, rel_tol=1e-9, max_iter=5000,
                         trait="quality", **kw)
    return _optimality(spark, res["problem"], res["fit"], JOB_LAMBDA, 1e-4)


def q_lasso_job_files(spark, d):
    """M19 end to end on files: both tables written as sample-major TSV,
    scanned, joined on id, fitted (response: the ``quality`` trait), then the
    optimality of every coefficient."""
    return _job_files(spark, d, "lasso-job", n_blocks=EMB_BLOCKS)


def q_lasso_job_wide(spark, d):
    """M18/M19 on files, with fat blocks of fewer rows than features."""
    return _job_files(spark, d, "lasso-job-wide", mode="fat", rows_per_block=JOB_ROWS_PER_BLOCK)


def q_lasso_interactions(spark, d):
    """M18/P10 + M11: LASSO over all main effects and pairwise products of the
    embeddings (p(p+1)/2 features, more than the rows of any block), fitted
    with fat blocks; the optimality of every coefficient."""
    m = emb_matrix(spark, d)
    names = features.interactions(m, m.width()).names
    prob = admm.prepare(m.df, rho="auto", mode="fat", rows_per_block=WIDE_ROWS_PER_BLOCK,
                        names=names, pairs=True)
    f = admm.fit(prob, WIDE_LAMBDA, max_iter=5000, abs_tol=1e-8, rel_tol=1e-8)
    return _optimality(spark, prob, f, WIDE_LAMBDA, 1e-3)


def q_lasso_feature_split(spark, d):
    """M18/M11 by columns: the same model on at least four column blocks (sharing
    ADMM); no task holds a vector of all pairs next to its data."""
    m = emb_matrix(spark, d)
    cols = sharing.column_blocks(m.df, n_blocks=COLUMN_BLOCKS, pairs=True)
    f = sharing.fit_sharing(cols, WIDE_LAMBDA, abs_tol=1e-7, rel_tol=1e-7)
    return sharing.optimality(cols, f.coef, WIDE_LAMBDA, 1e-3 * WIDE_LAMBDA).select(
        "idx", "kkt_ok", r4(F.col("xty")).alias("xty"), F.lit(cols.n).cast("long").alias("n"))


def q_streaming_statistics(spark, d):
    """Streaming form of the block statistics: the embeddings written as
    sample-major files, read back as a file stream one file per micro-batch,
    joined to their labels (stream-static), accumulated per block; returns
    Aᵀb of everything seen."""
    from .. import streaming

    m = emb_matrix(spark, d)
    base = scratch_path(spark, "stream")
    folder = f"{base}/incoming"
    text.write_sample_major(m.df.repartition(3, "sample_id"), "features", m.names, folder)
    header = "\t".join(["<Marker>"] + [r["name"] for r in m.names.orderBy("idx").collect()])
    labels = m.df.select(F.col("sample_id").cast("string").alias("sample_id"), "label")
    stream = streaming.stream_sample_major(spark, folder, header, max_files_per_trigger=1)
    q = streaming.accumulate_block_statistics(stream.df.join(labels, "sample_id"),
                                              f"{base}/stats", f"{base}/checkpoint",
                                              n_blocks=EMB_BLOCKS)
    q.awaitTermination()
    blocks = streaming.read_block_statistics(spark, f"{base}/stats")
    return (blocks.select(F.posexplode("q0").alias("i", "c"))
            .groupBy("i").agg(r6(F.sum("c")).alias("xty"))
            .select(F.col("i").cast("int"), "xty"))


def q_predict(spark, d):
    """Score every sample with w = Aᵀb / n."""
    m = emb_matrix(spark, d)
    mom = moments.moments(m.df).orderBy("i").collect()
    import numpy as np
    w = np.array([r["c"] / r["n"] for r in mom])
    mdl = model.LassoModel(w)
    return mdl.predict(m.df).select("sample_id", r6(F.col("prediction")).alias("prediction"))


def q_mse(spark, d):
    """In-sample mean squared error of the fitted one-hot model."""
    f, names, df = onehot_fit(spark, d)
    mdl = model.LassoModel.from_fit(f, names)
    return mdl.mean_squared_error(df).select("n", r4(F.col("mse")).alias("mse"))


def q_lambda_grid(spark, d):
    """Fit a λ grid in lockstep, in-sample MSE and sparsity per λ."""
    prob, _, _ = onehot_problem(spark, d)
    g = tune.lambda_grid(prob, GRID, max_iter=5000, abs_tol=FIT_TOL, rel_tol=FIT_TOL)
    return g.results.select("pos", "lambda", r4(F.col("mse")).alias("mse"), "nnz")


def q_lambda_best(spark, d):
    """Arg-min of the grid (first minimum wins)."""
    prob, _, _ = onehot_problem(spark, d)
    g = tune.lambda_grid(prob, GRID, max_iter=5000, abs_tol=FIT_TOL, rel_tol=FIT_TOL)
    res = g.results.withColumn("mse", r4(F.col("mse")))
    return tune.best_lambda(res)


def q_model_roundtrip(spark, d):
    """Save the model, load it back; its coefficients, those of the
    text file, and the saved error."""
    prob, names, _ = onehot_problem(spark, d)
    f = admm.fit(prob, ONEHOT_LAMBDA, max_iter=5000, abs_tol=FIT_TOL, rel_tol=FIT_TOL)
    mdl = model.LassoModel.from_fit(f, names)
    mdl.mse = tune.in_sample_mse(prob, f.coef)
    path = scratch_path(spark, "model")
    mdl.save(spark, path)
    back = model.LassoModel.load(spark, path)
    lines = model.LassoModel.read_coefficient_text(spark, path).select(
        "name", F.col("coef").alias("text_coef"))
    return back.coefficients(spark).join(lines, "name", "left").select(
        "idx", "name", r4(F.col("coef")).alias("coef"), r4(F.col("text_coef")).alias("text_coef"),
        F.lit(round(back.mse, 4)).alias("mse"))


QUERIES = {
    "sample_matrix_long": q_sample_matrix_long,
    "feature_dictionary": q_feature_dictionary,
    "combined_scan": q_combined_scan,
    "combined_names": q_combined_names,
    "interaction_files": q_interaction_files,
    "sample_join": q_sample_join,
    "alignment_report": q_alignment_report,
    "positional_join": q_positional_join,
    "drop_features": q_drop_features,
    "transpose": q_transpose,
    "pairwise_interactions": q_pairwise_interactions,
    "interaction_names": q_interaction_names,
    "gram": q_gram,
    "xty": q_xty,
    "block_moments": q_block_moments,
    "block_sq_norms": q_block_sq_norms,
    "vector_mean": q_vector_mean,
    "soft_threshold": q_soft_threshold,
    "ridge_solve_p2": q_ridge_solve_p2,
    "lasso_onehot": q_lasso_onehot,
    "lasso_lineitem": q_lasso_lineitem,
    "admm_step": q_admm_step,
    "admm_three_rounds": q_admm_three_rounds,
    "history_two_rounds": q_history_two_rounds,
    "admm_history": q_admm_history,
    "warm_start": q_warm_start,
    "final_state": q_final_state,
    "fit_history": q_fit_history,
    "lasso_embeddings": q_lasso_embeddings,
    "lasso_job_files": q_lasso_job_files,
    "lasso_job_wide": q_lasso_job_wide,
    "lasso_interactions": q_lasso_interactions,
    "lasso_feature_split": q_lasso_feature_split,
    "streaming_statistics": q_streaming_statistics,
    "predict": q_predict,
    "mse": q_mse,
    "lambda_grid": q_lambda_grid,
    "lambda_best": q_lambda_best,
    "lasso_two_rho": q_lasso_two_rho,
    "cross_validation": q_cross_validation,
    "strong_path": q_strong_path,
    "round_timings": q_round_timings,
    "model_roundtrip": q_model_roundtrip,
}
