import pytest
from pyspark.sql import functions as F

from sparselm.operators import align


def _tables(spark):
    geno = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0]), ("c", [3.5])],
                                 "sample_id string, features array<double>")
    pheno = spark.createDataFrame([("a", [10.0, 1.0]), ("c", [30.0, 3.0]), ("d", [40.0, 4.0])],
                                  "sample_id string, traits array<double>")
    return geno, pheno


def test_inner_join_drops_and_multiplies(spark):
    geno, pheno = _tables(spark)
    j = align.join_samples(geno, pheno)
    assert sorted(r["sample_id"] for r in j.collect()) == ["a", "c", "c"]


def test_alignment_report(spark):
    geno, pheno = _tables(spark)
    r = align.alignment_report(geno, pheno).first().asDict()
    assert r == {"left_rows": 4, "right_rows": 3, "joined_rows": 3, "left_only_rows": 1,
                 "right_only_rows": 1, "left_dup_ids": 1, "right_dup_ids": 0}
    with pytest.raises(ValueError):
        align.alignment_report(geno, pheno, strict=True)


def test_design_picks_trait(spark):
    geno, pheno = _tables(spark)
    j = align.join_samples(geno, pheno)
    last = {r["sample_id"]: r["label"] for r in align.design(j).collect()}
    assert last["a"] == 1.0
    names = spark.createDataFrame([(0, "h"), (1, "w")], "idx int, name string")
    first = {r["sample_id"]: r["label"] for r in align.design(j, "h", names).collect()}
    assert first["a"] == 10.0


def test_row_index_dense_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3 % 1000).alias("v"))
    idx = align.with_row_index(df, "pos", ["v"]).collect()
    assert sorted(r["pos"] for r in idx) == list(range(1000))
    assert all(r["pos"] == r["v"] for r in idx)


def test_positional_join(spark):
    a = spark.createDataFrame([(5, "x"), (1, "y"), (3, "z")], "k int, a string")
    b = spark.createDataFrame([(9, 0.5), (7, 1.5)], "k2 int, b double")
    out = align.positional_join(a, b, ["k"], ["k2"]).orderBy("pos").collect()
    assert [(r["pos"], r["a"], r["b"]) for r in out] == [(0, "y", 1.5), (1, "z", 0.5)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_index_keeps_every_wide_row(spark, adaptive):
    """Wide rows in key order: partitions by size, not by count."""
    n = 300_000
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(n).select(
            F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), "id",
            F.repeat(F.col("id").cast("string"), 40).alias("payload"))
        idx = align.with_row_index(df, "pos", ["k", "id"])
        got = idx.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
        assert tuple(got) == (n, n, 0, n - 1)
        from pyspark.sql import Window
        before = F.lag("k").over(Window.partitionBy(F.floor(F.col("pos") / 1000)).orderBy("pos"))
        assert idx.select((before > F.col("k")).alias("bad")).where("bad").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_positional_join_through_shuffles(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(50_000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 200).alias("w"))
        b = spark.range(40_000).select((F.col("id") * 2).alias("k2"))
        out = align.positional_join(a.repartition(7), b.repartition(3), ["k"], ["k2"])
        assert out.count() == 40_000
        assert out.where("k <> pos OR k2 <> 2 * pos").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
