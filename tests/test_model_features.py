import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import write
from sparselm.operators import features, model
from sparselm.plans import jobs
from sparselm.sources import text
from sparselm.sources.text import LabeledMatrix


def _matrix(spark, rows, p):
    df = spark.createDataFrame(rows, "sample_id string, features array<double>")
    names = spark.createDataFrame([(i, f"m{i}") for i in range(p)], "idx int, name string")
    return LabeledMatrix(df, names, "features")


def test_predict_and_mse(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(50, 4))
    w = np.array([0.5, 0.0, -2.0, 0.0])
    y = X @ w + 0.1
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(50)],
                               "features array<double>, label double")
    m = model.LassoModel(w)
    pred = np.array([r["prediction"] for r in m.predict(df).collect()])
    assert np.allclose(pred, X @ w)
    r = m.mean_squared_error(df).first()
    assert r["n"] == 50 and np.isclose(r["mse"], 0.01)


def test_save_load_roundtrip(spark, tmpdir_path):
    m = model.LassoModel(np.array([0.0, 1.25, -3.0]), ["a", "b", "c"], lam=0.5, rho=1.0,
                         iterations=7, converged=True, training_seconds=1.5, mse=0.25)
    path = os.path.join(tmpdir_path, "model")
    m.save(spark, path)
    back = model.LassoModel.load(spark, path)
    assert np.array_equal(back.weights, m.weights) and back.names == ["a", "b", "c"]
    assert back.mse == 0.25 and back.lam == 0.5 and back.iterations == 7
    txt = sorted(r["value"] for r in spark.read.text(os.path.join(path, "coef.txt")).collect())
    assert txt == ["-3.0,c", "1.25,b"]


def test_nonzero_with_names(spark):
    coef = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, -0.5)], "idx int, coef double")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, name string")
    out = sorted(tuple(r) for r in model.nonzero_coefficients(coef, names)
                 .select("idx", "name", "coef").collect())
    assert out == [(1, "b", 2.0), (2, "c", -0.5)]


def test_interactions_order_and_names(spark):
    m = _matrix(spark, [("s", [1.0, 2.0, 3.0, 5.0])], 4)
    out = features.interactions(m)
    assert out.df.first()["features"] == [1.0, 2.0, 3.0, 5.0, 2.0, 3.0, 5.0, 6.0, 10.0, 15.0]
    names = [r["name"] for r in out.names.orderBy("idx").collect()]
    assert names == ["m0", "m1", "m2", "m3", "m0:m1", "m0:m2", "m0:m3", "m1:m2", "m1:m3",
                     "m2:m3"]
    long = features.interactions_long(m, 4).orderBy("k", "j").collect()
    assert [(r["k"], r["j"], r["value"]) for r in long][:2] == [(0, 1, 2.0), (0, 2, 3.0)]


def test_interactions_small_widths(spark):
    one = features.interactions(_matrix(spark, [("s", [4.0])], 1))
    assert one.df.first()["features"] == [4.0]
    two = features.interactions(_matrix(spark, [("s", [4.0, 0.5])], 2))
    assert two.df.first()["features"] == [4.0, 0.5, 2.0]


def test_drop_features_reindexes(spark):
    m = _matrix(spark, [("s", [0.0, 1.0, 2.0, 3.0, 4.0])], 5)
    out = features.drop_features(m, [0, 3])
    assert out.df.first()["features"] == [1.0, 2.0, 4.0]
    assert [tuple(r) for r in out.names.orderBy("idx").collect()] == [(0, "m1"), (1, "m2"),
                                                                        (2, "m4")]


def _marker_major(tmp):
    return write(os.path.join(tmp, "mm.tsv"), [
        "rs\tallele\tchrom\tpos\tstrand\tA\tB\tC",
        "mk1\tx\t1\t10\t+\t1\t0\t2",
        "mk2\tx\t1\t20\t+\t0\t1\t1",
        "mk3\tx\t2\t30\t+\t2\t2\t0",
    ])


def test_transpose(spark, tmpdir_path):
    m = features.transpose_long(text.read_marker_major(spark, _marker_major(tmpdir_path)))
    rows = {r["sample_id"]: r["features"] for r in m.df.collect()}
    assert rows == {"A": [1.0, 0.0, 2.0], "B": [0.0, 1.0, 2.0], "C": [2.0, 1.0, 0.0]}


def test_interaction_job(spark, tmpdir_path):
    mm = _marker_major(tmpdir_path)
    ph = write(os.path.join(tmpdir_path, "ph.tsv"), ["id\tt1", "A\t0.5", "B\t1.5", "C\t2.5"])
    out = os.path.join(tmpdir_path, "combined")
    n_traits = jobs.interaction_job(spark, mm, ph, out)
    assert n_traits == 1
    lines = sorted(r["value"] for r in spark.read.text(out).collect())
    # traits, main effects, then products (0,1), (0,2), (1,2)
    assert lines == ["0.5\t1.0\t0.0\t2.0\t0.0\t2.0\t0.0",
                     "1.5\t0.0\t1.0\t2.0\t0.0\t0.0\t2.0",
                     "2.5\t2.0\t1.0\t0.0\t2.0\t0.0\t0.0"]
    pos = sorted(r["value"] for r in jobs.interaction_rows(spark, mm, ph, positional=True)[0]
                 .collect())
    assert pos == lines


def test_grid_job_on_combined_file(spark, tmpdir_path):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(80, 4))
    y = X @ np.array([1.5, 0.0, -0.8, 0.0]) + 0.05 * rng.normal(size=80)
    lines = ["2\t4\t80", "a\tb\tc\td"] + [
        "\t".join(repr(float(v)) for v in [y[i], 7.0] + X[i].tolist()) for i in range(80)]
    p = write(os.path.join(tmpdir_path, "combined.tsv"), lines)
    out = os.path.join(tmpdir_path, "grid")
    res = jobs.grid_job(spark, p, [30.0, 3.0, 0.3], out=out, max_iter=5000,
                        abs_tol=1e-10, rel_tol=1e-10)
    assert res["grid"].best_pos == 2
    ols = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose(res["model"].weights, ols, atol=0.02)
    back = model.LassoModel.load(spark, os.path.join(out, "model"))
    assert np.allclose(back.weights, res["model"].weights)
    assert spark.read.parquet(os.path.join(out, "grid")).count() == 3


def test_interaction_job_copies_trait_text(spark, tmpdir_path):
    mm = _marker_major(tmpdir_path)
    ph = write(os.path.join(tmpdir_path, "ph2.tsv"),
               ["id\tt1", "A\t1.190813250933200", "B\t2", "C\t0.50"])
    out = os.path.join(tmpdir_path, "combined2")
    jobs.interaction_job(spark, mm, ph, out)
    firsts = sorted(r["value"].split("\t")[0] for r in spark.read.text(out).collect())
    assert firsts == ["0.50", "1.190813250933200", "2"]


@pytest.mark.parametrize("nonzero", [0, 3, 300, 400, 512, 513, 5000])
def test_prediction_is_one_path_at_every_size(spark, nonzero):
    p = 5200
    rng = np.random.default_rng(nonzero)
    w = np.zeros(p)
    w[rng.choice(p - 1, nonzero, replace=False)] = rng.normal(size=nonzero)
    X = rng.normal(size=(4, p))
    X[1, p - 1] = np.nan                    # at a weight of zero
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(4)],
                               "i int, features array<double>")
    got = {r["i"]: r["prediction"] for r in model.LassoModel(w).predict(df).collect()}
    want = np.nan_to_num(X) @ w
    assert np.allclose([got[i] for i in range(4)], want)
    short = spark.createDataFrame([(X[0].tolist()[:-1],)], "features array<double>")
    with pytest.raises(Exception, match="expected 5200 features"):
        model.LassoModel(w).predict(short).collect()


def test_transpose_rejects_a_missing_cell(spark):
    long = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)],
                                 "marker_idx int, sample_idx int, value double")
    markers = spark.createDataFrame([(0, "a"), (1, "b")], "marker_idx int, marker string")
    samples = spark.createDataFrame([(0, "s"), (1, "t")], "sample_idx int, sample_id string")
    with pytest.raises(Exception, match="one cell per marker"):
        features.transpose_long(text.MarkerMajor(long, markers, samples)).df.collect()


def test_interaction_output_feeds_the_grid_job(spark, tmpdir_path):
    mm = _marker_major(tmpdir_path)
    ph = write(os.path.join(tmpdir_path, "ph3.tsv"), ["id\tt1", "A\t0.5", "B\t1.5", "C\t2.5"])
    out = os.path.join(tmpdir_path, "combined3")
    jobs.interaction_job(spark, mm, ph, out, header=True)
    res = jobs.grid_job(spark, out, [0.1, 1.0], max_iter=200)
    assert res["model"].names == ["mk1", "mk2", "mk3", "mk1:mk2", "mk1:mk3", "mk2:mk3"]


def test_marker_major_in_blocks_of_samples(spark, tmpdir_path):
    """The blocks together are the whole table; other markers are refused."""
    lead = "rs\tallele\tchrom\tpos\tstrand"
    a = write(os.path.join(tmpdir_path, "a.tsv"), [
        lead + "\tA\tB", "mk1\tx\t1\t10\t+\t1\t0", "mk2\tx\t1\t20\t+\t0\t1",
        "mk3\tx\t2\t30\t+\t2\t2"])
    b = write(os.path.join(tmpdir_path, "b.tsv"), [
        lead + "\tC", "mk1\tx\t1\t10\t+\t2", "mk2\tx\t1\t20\t+\t1", "mk3\tx\t2\t30\t+\t0"])
    c = write(os.path.join(tmpdir_path, "c.tsv"), [
        lead + "\tD", "mk2\tx\t1\t10\t+\t2", "mk1\tx\t1\t20\t+\t1", "mk3\tx\t2\t30\t+\t0"])
    m = features.transpose_long(text.read_marker_major_blocks(spark, [a, b]))
    rows = {r["sample_id"]: r["features"] for r in m.df.collect()}
    assert rows == {"A": [1.0, 0.0, 2.0], "B": [0.0, 1.0, 2.0], "C": [2.0, 1.0, 0.0]}
    with pytest.raises(ValueError, match="different markers"):
        text.read_marker_major_blocks(spark, [a, c])


def test_transpose_moves_cells_once(spark, monkeypatch):
    """Many tiles, nulls and shuffled cells; one exchange of the cells, one of the
    names."""
    monkeypatch.setattr(features, "TILE_CELLS", 64)
    rng = np.random.default_rng(3)
    X = rng.normal(size=(50, 11))
    cells = [(j, i, None if (i + j) % 17 == 0 else float(X[i, j]))
             for i in range(50) for j in range(11)]
    rng.shuffle(cells)
    long = spark.createDataFrame([(int(a), int(b), c) for a, b, c in cells],
                                 "marker_idx int, sample_idx int, value double").repartition(3)
    markers = spark.createDataFrame([(j, f"m{j}") for j in range(11)], "marker_idx int, marker string")
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(49)], "sample_idx int, sample_id string")
    m = features.transpose_long(text.MarkerMajor(long, markers, samples))
    got = {r["sample_id"]: r["features"] for r in m.df.collect()}
    assert got == {f"s{i}": [None if (i + j) % 17 == 0 else X[i, j] for j in range(11)]
                   for i in range(49)}
    plan = m.df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(block") == 2
    twice = long.union(long.limit(1))
    with pytest.raises(Exception, match="one cell per marker"):
        features.transpose_long(text.MarkerMajor(twice, markers, samples)).df.collect()


def test_pair_products_of_any_row(spark):
    from sparselm.functions.vectors import pair_products

    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None), (2, []), (3, [4.0]),
                                (4, [2.0, None, 5.0])], "i int, v array<double>")
    got = {r["i"]: r["p"] for r in df.select("i", pair_products("v").alias("p")).collect()}
    assert got == {0: [2.0, 3.0, 6.0], 1: None, 2: [], 3: [], 4: [None, 10.0, None]}
    with pytest.raises(Exception, match="expected 3 features"):
        df.select(pair_products("v", 3)).collect()


def test_interaction_files_take_as_many_jobs_for_any_number_of_blocks(spark, monkeypatch):
    from sparselm.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    sc, seen = spark.sparkContext, []
    for size in (100, 20):
        monkeypatch.setattr(catalog, "FILE_SAMPLES", size)
        sc.setJobGroup(f"blocks-of-{size}", "")
        rows = sorted(map(tuple, catalog.q_interaction_files(spark, sf).collect()))
        seen.append((rows, len(sc.statusTracker().getJobIdsForGroup(f"blocks-of-{size}"))))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0][0] and seen[0][0] == seen[1][0]
    assert seen[1][1] <= seen[0][1] + 5
