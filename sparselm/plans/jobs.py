"""End-to-end jobs.

* :func:`lasso_job` — genotype table + phenotype table → aligned design →
  consensus-ADMM fit → coefficient / history / evaluation outputs.
* :func:`interaction_job` — marker-major genotype + phenotype table →
  combined matrix rows (traits, main effects, pairwise products) as text.
* :func:`grid_job` — combined matrix (two header lines) → λ grid → the best
  model saved with its grid table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admm, align, features, model
from ..session import delete_path, written
from ..sources import text


def lasso_job(spark: SparkSession, geno_path: str, pheno_path: str, out: str | None = None,
              lam: float = 0.5, max_iter: int = 1000, abs_tol: float = 1e-6,
              rel_tol: float = 1e-6, rho: float | str = 1.0, n_blocks: int | None = None,
              trait=None, strict: bool = False, logs: bool = False, mode: str = "dense",
              rows_per_block: int | None = None) -> dict:
    """Read, align, fit, report. Writes ``out/model``, ``out/history``,
    ``out/state`` and ``out/report`` when ``out`` is given. Wide genotype
    tables (more features than a dense block can factor) take ``mode="fat"``."""
    geno = text.read_sample_major(spark, geno_path)
    pheno = text.read_traits(spark, pheno_path)
    # one row, computed once: checked here if strict, and written below
    report = align.alignment_report(geno, pheno, strict=strict)
    report = spark.createDataFrame(report.collect(), report.schema)
    data = align.design(align.join_samples(geno, pheno), trait=trait, trait_names=pheno.names)
    problem = admm.prepare(data, n_blocks=n_blocks, rho=rho, names=geno.names, mode=mode,
                           rows_per_block=rows_per_block)
    fit = admm.fit(problem, lam, max_iter=max_iter, abs_tol=abs_tol, rel_tol=rel_tol, logs=logs)
    names = [r["name"] for r in geno.names.orderBy("idx").collect()]
    m = model.LassoModel.from_fit(fit, names)
    from ..operators.tune import in_sample_mse
    m.mse = in_sample_mse(problem, fit.coef)
    result = {"fit": fit, "model": m, "report": report, "problem": problem}
    if out:
        m.save(spark, os.path.join(out, "model"))
        fit.history().write.mode("overwrite").parquet(os.path.join(out, "history"))
        fit.final_state().write.mode("overwrite").parquet(os.path.join(out, "state"))
        report.write.mode("overwrite").json(os.path.join(out, "report"))
    return result


def interaction_rows(spark: SparkSession, marker_major_path: str | list[str], pheno_path: str,
                     lead: int = 5, positional: bool = False
                     ) -> tuple[DataFrame, int, int, text.LabeledMatrix]:
    """Combined rows ``(sample_id, value)``, the marker and trait counts, and
    the transposed genotype table. A list of paths holds the genotypes in blocks
    of samples (:func:`..sources.text.read_marker_major_blocks`)."""
    mm = (text.read_marker_major(spark, marker_major_path, lead)
          if isinstance(marker_major_path, str)
          else text.read_marker_major_blocks(spark, marker_major_path, lead))
    geno = features.transpose_long(mm)
    pheno = text.read_traits(spark, pheno_path, keep_text=True)  # traits copied verbatim
    p = geno.width()
    if positional:
        # i-th sample column ↔ i-th trait row in file order, ids ignored
        lines = text.read_lines(spark, pheno_path)
        header = text.head_lines(lines)
        if not header:
            raise ValueError("empty input: no header line")
        lines = align.with_row_index(lines.where(F.col("value") != F.lit(header[0])), "pos")
        t = text.parse_sample_major(lines, "traits", header=header[0], keep_text=True,
                                    keep=["pos"]).df.drop("sample_id")
        g = geno.df.select(F.col("sample_idx").cast("long").alias("pos"), "sample_id", "features")
        pairs = g.join(t, "pos")
        rows = pairs.select("sample_id", features.combined_line(pairs, p).alias("value"))
    else:
        rows = features.combined_rows(geno.df.select("sample_id", "features"), pheno.df, p)
    return rows, p, pheno.width(), geno


def interaction_job(spark: SparkSession, marker_major_path: str | list[str], pheno_path: str,
                    out: str,
                    lead: int = 5, positional: bool = False, header: bool = False) -> int:
    """Write the combined matrix as TSV text; returns the trait count.

    By default headerless; ``header=True`` puts the two header lines first (the
    rows are then written once to the checkpoint folder, to be counted), so
    that :func:`grid_job` reads the output."""
    rows, p, n_traits, geno = interaction_rows(spark, marker_major_path, pheno_path, lead,
                                               positional)
    if not header:
        rows.select("value").write.mode("overwrite").text(out)
        return n_traits
    rows, path = written(spark, rows.select("value"), "combined-rows")
    names = features.interactions(geno, p).names if p > 1 else geno.names
    names = [r["name"] for r in names.orderBy("idx").collect()]      # the header line's cells
    text.write_combined(rows, out, n_traits, names, rows.count())
    delete_path(spark, path)
    return n_traits


def grid_job(spark: SparkSession, combined_path: str, lambdas, out: str | None = None,
             trait: int = 0, rho: float | str = "auto", n_blocks: int | None = None,
             mode: str = "dense", rows_per_block: int | None = None, **fit_kw) -> dict:
    """Combined-matrix file → penalty grid → best model.

    The response is trait ``trait`` (first by default, as in the combined
    layout); features follow the traits. All λ share one data scan and run in
    lockstep; the model with the smallest in-sample MSE is saved to
    ``out/model`` and the grid table to ``out/grid``.
    """
    from ..operators import tune

    matrix = text.read_combined(spark, combined_path)
    data = align.design(matrix.df, trait=trait)
    problem = admm.prepare(data, n_blocks=n_blocks, rho=rho, names=matrix.names, mode=mode,
                           rows_per_block=rows_per_block)
    matrix.check_rows(problem.n)
    grid = tune.lambda_grid(problem, lambdas, **fit_kw)
    names = [r["name"] for r in matrix.names.orderBy("idx").collect()]
    best = model.LassoModel.from_fit(grid.best, names)
    best.mse = float(grid.results.where(F.col("pos") == grid.best_pos).first()["mse"])
    if out:
        best.save(spark, os.path.join(out, "model"))
        grid.results.write.mode("overwrite").parquet(os.path.join(out, "grid"))
    return {"grid": grid, "model": best, "problem": problem}
