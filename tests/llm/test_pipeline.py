"""The corpus pipeline, stage by stage, against brute force."""

import os

import pytest

from tests.llm import brute
from tests.llm.test_operators import BASE, ITEMS, NEAR, ROWS, SECRET, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    extra = [(1000 + k, prose(60, 2000 + k) if k % 4 else " ".join(["zzz"] * 60))
             for k in range(120)]
    spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in ROWS + extra],
        "doc_id long, text string, lang string, source string, n_chars long, key string") \
        .write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1000 + k, int(k % 4 > 0), 0) for k in range(120)],
                          "doc_id long, quality int, toxic int").write.parquet(
        f"{base}/labels.parquet")
    spark.createDataFrame([x for x in ITEMS if x[0] != 10], "item_id long, text string") \
        .write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, tables):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_filter", "near_duplicates", "decontamination",
                                        "secret_masking", "packing"]
    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    good = stages["quality_filter"](spark, docs, tables)
    assert good.columns == docs.columns
    left = {r["doc_id"] for r in good.collect()}
    assert not any(1000 + k in left for k in range(0, 120, 4))
    assert all(1000 + k in left for k in range(120) if k % 4)

    single = stages["near_duplicates"](spark, docs, tables)
    assert single.columns == docs.columns
    comp = brute.near_duplicates(rows, 80)
    want = {c for (i, t), (n, c) in zip(rows, comp) if n}
    got = [(r["doc_id"], r["text"]) for r in single.collect()]
    kept = [i for i, t in got if brute.shingles(t)]
    assert sorted(kept, key=str) == sorted(want, key=str) and len(set(kept)) == len(kept)
    empty = {x for x in rows if not brute.shingles(x[1])}
    assert {x for x in got if not brute.shingles(x[1])} == empty
    assert (1, BASE) in got and (2, NEAR) not in got

    clean = stages["decontamination"](spark, docs, tables)
    hit = brute.contamination([t for _, t in rows], [x for x in ITEMS if x[0] != 10])
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(
        str(i) for (i, _), (_, n, _) in zip(rows, hit) if not n)

    masked = stages["secret_masking"](spark, docs, tables)
    assert masked.columns == docs.columns
    out = masked.collect()
    assert len(out) == len(rows)
    for r in out:
        assert not brute.secrets(r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert {r["text"] for r in out if r["doc_id"] == 1} == {BASE}
    assert SECRET not in {r["text"] for r in out}

    packed = stages["packing"](spark, docs, tables)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in rows})


def test_stages_take_empty_tables(spark, tables):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, tables).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_run(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SF).collect()
    assert rows and all(r["offset"] + r["length"] <= 2048 for r in rows)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs at 0.8 that 24 bands of 6 slots all miss (four of 7,000 tried)."""
    import corpus_pipeline as P

    rows = []
    for k in (33767, 35297, 36261, 36287):
        w = prose(104, k).split()
        rows += [(2 * k, " ".join(w[:94])), (2 * k + 1, " ".join(w[10:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in dict(P.STAGES)["near_duplicates"](spark, docs, "").collect()}
    want = {c for _, c in brute.near_duplicates(rows, 80)}
    assert got == want and len(want) == 4
