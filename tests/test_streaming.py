import os

import numpy as np
from pyspark.sql import functions as F

from conftest import write
from sparselm import streaming
from sparselm.operators import admm


def test_stream_accumulates_same_problem(spark, tmpdir_path):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(60, 3))
    y = X @ np.array([1.0, 0.0, -2.0]) + 0.1 * rng.normal(size=60)
    header = "id\ta\tb\tc"
    folder = os.path.join(tmpdir_path, "incoming")
    os.makedirs(folder)
    for part in range(3):
        rows = [header] + [f"s{i}\t" + "\t".join(repr(float(v)) for v in X[i])
                           for i in range(part * 20, part * 20 + 20)]
        write(os.path.join(folder, f"part{part}.tsv"), rows)
    labels = spark.createDataFrame([(f"s{i}", float(y[i])) for i in range(60)],
                                   "sample_id string, label double")

    m = streaming.stream_sample_major(spark, folder, header, max_files_per_trigger=1)
    samples = m.df.join(labels, "sample_id")       # stream-static join
    table = os.path.join(tmpdir_path, "stats")
    q = streaming.accumulate_block_statistics(samples, table,
                                              os.path.join(tmpdir_path, "ckpt"), n_blocks=2)
    q.awaitTermination(120)
    batches = [pr for pr in q.recentProgress if pr["numInputRows"] > 0]
    assert len(batches) == 3                       # one file per micro-batch

    prob = streaming.problem_from_stream(spark, table, rho="auto")
    assert prob.n == 60 and np.allclose(prob.xty, X.T @ y)
    f = admm.fit(prob, 2.0, max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    batch = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(60)],
                                  "features array<double>, label double")
    ref = admm.fit(admm.prepare(batch, block_col=F.lit(0), rho="auto"), 2.0,
                   max_iter=5000, abs_tol=1e-10, rel_tol=1e-10)
    assert np.allclose(f.coef, ref.coef, atol=1e-6)
