import os

import pytest
from pyspark.sql import functions as F

from conftest import write
from sparselm.sources import text


def _geno(tmp):
    return write(os.path.join(tmp, "geno.tsv"), [
        "<Marker>\tm1\tm2\tm3",
        "s1\t1.0\t0.0\t2.0",
        "s2\t0.0\t1.0\t1.0\t\t",          # trailing tabs are ignored
        '"s3"\t1.5\t2.5\t0.5',             # quotes stay part of the id
    ])


def test_sample_major_scan(spark, tmpdir_path):
    m = text.read_sample_major(spark, _geno(tmpdir_path))
    rows = {r["sample_id"]: r["features"] for r in m.df.collect()}
    assert rows == {"s1": [1.0, 0.0, 2.0], "s2": [0.0, 1.0, 1.0], '"s3"': [1.5, 2.5, 0.5]}
    assert [tuple(r) for r in m.names.orderBy("idx").collect()] == [(0, "m1"), (1, "m2"),
                                                                      (2, "m3")]
    long = m.long().where(F.col("sample_id") == "s1").orderBy("idx").collect()
    assert [(r["idx"], r["value"]) for r in long] == [(0, 1.0), (1, 0.0), (2, 2.0)]


def test_header_repeated_in_folder(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "folder")
    os.makedirs(d)
    write(os.path.join(d, "a.tsv"), ["id\tx", "a\t1.0"])
    write(os.path.join(d, "b.tsv"), ["id\tx", "b\t2.0"])
    m = text.read_sample_major(spark, d)
    assert sorted((r["sample_id"], r["features"][0]) for r in m.df.collect()) == [
        ("a", 1.0), ("b", 2.0)]


def test_bad_cell_strict_and_lenient(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "bad.tsv"), ["id\tx\ty", "a\t1.0\tzz"])
    with pytest.raises(Exception):
        text.read_sample_major(spark, p).df.collect()
    rows = text.read_sample_major(spark, p, lenient=True).df.collect()
    assert rows[0]["features"] == [1.0, None]


def test_marker_major_scan(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "mm.tsv"), [
        "rs\tallele\tchrom\tpos\tstrand\tA\tB\tC\tD",
        "mk1\tx\t1\t10\t+\t1\t0\t1\t2",
        "mk2\tx\t1\t20\t+\t0\t0\t1\t1",
        "mk3\tx\t2\t30\t+\t2\t1\t0\t0",
    ])
    mm = text.read_marker_major(spark, p, lead=5)
    cells = {(r["marker_idx"], r["sample_idx"]): r["value"] for r in mm.long.collect()}
    assert len(cells) == 12 and cells[(2, 0)] == 2.0 and cells[(0, 3)] == 2.0
    assert [r["marker"] for r in mm.markers.orderBy("marker_idx").collect()] == ["mk1", "mk2",
                                                                                 "mk3"]
    assert [r["sample_id"] for r in mm.samples.orderBy("sample_idx").collect()] == list("ABCD")


def test_combined_scan(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "comb.tsv"), [
        "2\t3\t2", "f1\tf2\tf3",
        "0.5\t1.5\t1\t2\t3",
        "0.25\t2.5\t4\t5\t6",
    ])
    m = text.read_combined(spark, p)
    rows = sorted((r["traits"], r["features"]) for r in m.df.collect())
    assert rows == [([0.25, 2.5], [4.0, 5.0, 6.0]), ([0.5, 1.5], [1.0, 2.0, 3.0])]
    assert [r["name"] for r in m.names.orderBy("idx").collect()] == ["f1", "f2", "f3"]
    m.check_rows(2)
    with pytest.raises(ValueError):
        m.check_rows(3)


def test_combined_header_is_checked(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "bad.tsv"), ["1\t3\t1", "a\tb", "1\t2\t3\t4"])
    with pytest.raises(ValueError, match="names 2"):
        text.read_combined(spark, p)
    p = write(os.path.join(tmpdir_path, "short.tsv"), ["1\t3\t1", "a\tb\tc", "1\t2\t3"])
    with pytest.raises(Exception, match="cells"):
        text.read_combined(spark, p).df.collect()


def test_combined_rows_that_look_like_the_header(spark, tmpdir_path):
    # one trait, two features: rows as wide as the line of counts
    p = write(os.path.join(tmpdir_path, "three.tsv"), ["1\t2\t2", "a\tb", "1\t2\t2", "5\t6\t7"])
    m = text.read_combined(spark, p)
    assert sorted(r["traits"][0] for r in m.df.collect()) == [1.0, 5.0]


def _folder(tmp, name, files):
    d = os.path.join(tmp, name)
    os.makedirs(d)
    for f, lines in files:
        write(os.path.join(d, f), lines)
    return d


def test_folders_are_read_in_file_order(spark, tmpdir_path):
    """The second file is much larger, so scans deal it out first."""
    head = "rs\ta\tc\tp\ts\tA\tB"
    d = _folder(tmpdir_path, "mm", [
        ("a.tsv", [head, "m0\tx\t1\t1\t+\t1\t2", "m1\tx\t1\t1\t+\t3\t4"]),
        ("b.tsv", [head] + [f"m{i}\tx\t1\t1\t+\t{i}.0000000001\t{i}" for i in range(2, 400)])])
    mm = text.read_marker_major(spark, d)
    assert [r["sample_id"] for r in mm.samples.orderBy("sample_idx").collect()] == ["A", "B"]
    assert [r["marker"] for r in mm.markers.orderBy("marker_idx").collect()] == [
        f"m{i}" for i in range(400)]
    d = _folder(tmpdir_path, "comb", [
        ("part-0", ["1\t3\t301", "a\tb\tc", "0\t1\t1\t1"]),
        ("part-1", [f"{i}\t{i}.5\t2.00000000001\t3" for i in range(1, 301)])])
    m = text.read_combined(spark, d)
    assert [r["name"] for r in m.names.orderBy("idx").collect()] == ["a", "b", "c"]
    assert sorted(r["traits"][0] for r in m.df.collect()) == [float(i) for i in range(301)]


def test_rows_of_another_width_are_rejected(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "w.tsv"), ["id\tx\ty", "a\t1\t2", "b\t1"])
    with pytest.raises(Exception, match="cells"):
        text.read_sample_major(spark, p).df.collect()
    p = write(os.path.join(tmpdir_path, "r.tsv"), [
        "rs\ta\tc\tp\ts\tA\tB", "m0\tx\t1\t1\t+\t1\t2", "m1\tx\t1\t1\t+\t3"])
    with pytest.raises(Exception, match="cells"):
        text.read_marker_major(spark, p).long.collect()


def test_format_roundtrip(spark):
    df = spark.createDataFrame([("a", [1.0, 2.5e-7]), ("b", [3.0, -4.0])],
                               "sample_id string, features array<double>")
    names = spark.createDataFrame([(0, "u"), (1, "v")], "idx int, name string")
    back = text.parse_sample_major(text.format_sample_major(df, "features", names))
    assert sorted((r["sample_id"], r["features"]) for r in back.df.collect()) == [
        ("a", [1.0, 2.5e-7]), ("b", [3.0, -4.0])]
    assert [r["name"] for r in back.names.orderBy("idx").collect()] == ["u", "v"]


def test_write_sample_major_every_file_has_header(spark, tmpdir_path):
    rows = [(f"s{i}", [float(i), float(-i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, features array<double>").repartition(4)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, name string")
    out = os.path.join(tmpdir_path, "written")
    text.write_sample_major(df, "features", names, out, id_label="id")
    parts = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(parts) >= 2
    for f in parts:
        with open(os.path.join(out, f)) as fh:
            assert fh.readline().rstrip("\n") == "id\ta\tb"
    back = text.read_sample_major(spark, out)
    assert sorted((r["sample_id"], r["features"]) for r in back.df.collect()) == sorted(rows)
