"""Every operator on a small hard fixture, against brute force: nulls in any
column, empty and long texts, ties, repeated rows, columns of clashing names;
and on empty tables."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselm.llm import (decontaminate, embedding_dedup, license_scan, maxent_lm, minhash_dedup,
                          packing, quality, secret_scan, suffix_dedup, token_counts)
from sparselm.llm.tables import crc_mod5
from tests.llm import brute

rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(6000, 1)
BASE = prose(120, 2)
NEAR = " ".join(w if i % 40 else w + "x" for i, w in enumerate(BASE.split()))
SECRET = 'key token = "0123456789abcdef0123" AKIA' + "B7" * 8 + " password:short api_key=abcdefghijklmno"
ROWS = [
    (1, BASE), (2, NEAR), (3, BASE.upper()), (4, BASE), (4, BASE), (4, prose(30, 3)),
    (5, None), (6, ""), (7, "   \n\t "), (None, BASE), (None, None), (8, LONG),
    (9, prose(200, 4) + "\n" + LONG[500:1200] + " tail " + prose(20, 5)),
    (10, "Released under the MIT License.\nmit license Apache License general public license"),
    (11, SECRET), (12, "é " * 30 + SECRET + " ñandú"), (13, "aaaa" * 400), (14, "one two three"),
    (15, "all rights reserved"), (16, "licensed UNDER the apache license, version 2.0!\nx"),
    (17, "ONE two three"), (18, prose(80, 6) + " " + prose(12, 90) + " " + prose(20, 7)),
    (19, prose(9, 91)), (20, "tokentoken:secret=abcdefghijklmnop token=password:abcdefghijkl"),
    (21, "\x00\x1f~ |<|endoftext|> \U0001f600 日本語"),
]
ITEMS = [(1, prose(12, 90)), (2, prose(9, 91)), (2, prose(12, 90)), (3, None), (4, ""),
         (None, prose(14, 92)), (5, "one two three"), (10, BASE)]
CLASH = ["id", "row", "score", "tkey", "key", "doc", "spans", "label", "cls", "w", "rank", "core"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(i, t, "en" if k % 3 else None, None, None if t is None else len(t), *[f"c{k}"] * len(CLASH))
         for k, (i, t) in enumerate(ROWS)],
        "doc_id long, text string, lang string, source string, n_chars long, "
        + ", ".join(f"{c} string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def same(rows, want):
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_suffix_dedup(spark, docs, none):
    got = suffix_dedup.repeated_strings(spark, docs, with_text=True).collect()
    want = brute.repeated_bytes([t for _, t in ROWS], 400)
    same([(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got],
         [(i, *w) for (i, _), w in zip(ROWS, want)])
    assert any(w[1] and w[1] < w[0] for w in want)
    for r in got:
        if r["kept"] is not None:
            assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert suffix_dedup.repeated_strings(spark, none).count() == 0


def test_suffix_dedup_of_a_crowded_core(spark, monkeypatch):
    """One passage between ever different neighbours, counted window by window."""
    monkeypatch.setattr(suffix_dedup, "MOST_VARIANTS", 3)
    texts = [prose(20, 100 + k) + " " + LONG[:600] + " " + prose(20, 200 + k) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.repeated_strings(spark, df).collect()
    want = brute.repeated_bytes(texts, 400)
    same([(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got],
         [(k, *w) for k, w in enumerate(want)])


def test_suffix_dedup_deals_the_copies_of_a_text_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_ROWS", 16, raising=False)
    fullest, inner = {}, suffix_dedup.saved

    def saved(spark, df, name):
        by_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        fullest[name] = (max(by_task, default=0), sum(by_task))
        return inner(spark, df, name)

    monkeypatch.setattr(suffix_dedup, "saved", saved)
    monkeypatch.setattr(suffix_dedup, "MOST_VARIANTS", 50)
    texts = [LONG[:400]] * 3000 + [prose(15, 100 + k) + " " + LONG[600:1100] + " "
                                   + prose(15, 300 + k) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = suffix_dedup.repeated_strings(spark, df).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = brute.repeated_bytes(texts, 400)
    assert all(tuple(r[1:5]) == want[r["id"]] for r in got) and len(got) == len(texts)
    most, rows = fullest["sa-repeated"]
    assert most < rows / 3


def test_suffix_dedup_of_passages_copied_to_the_start_of_a_text(spark):
    """First equal windows that lie behind the head of the source's block."""
    source = prose(60_000, 20)
    texts = [source] + [source[t:t + 420] for t in range(200, len(source) - 420, 450)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.repeated_strings(spark, df).collect()
    want = brute.repeated_bytes(texts, 400)
    assert len(texts) > 500 and all(n == gone for n, gone, _, _ in want[1:])
    same([(r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got],
         [(k, *w) for k, w in enumerate(want)])


def test_license_scan(spark, docs, none):
    got = {}
    for r in license_scan.license_scan(spark, docs).collect():
        got.setdefault((r["id"], r["n_words"]), r)
    assert len(got) == len({(i, len(brute.words(t))) for i, t in ROWS})
    ten = got[(10, len(brute.words(ROWS[13][1])))]
    assert (ten["n_base"], ten["first_word"], ten["last_word"]) == (4, 3, 9)
    assert ten["base_labels"] == ["apache", "gpl", "mit"] and ten["score"] == 1.0
    by = {r["id"]: r for r in got.values()}
    assert by[15]["labels"] == ["all-rights-reserved"] and by[15]["n_base"] == 0
    assert by[16]["labels"] == ["apache"] and by[16]["blocks"][0]["line"] == 0
    assert by[5]["n_words"] == 0 and by[5]["labels"] == [] and by[5]["first_word"] is None
    assert license_scan.license_scan(spark, none).count() == 0


def test_license_scan_of_wrapped_notices_and_scattered_words(spark):
    """Every template hard-wrapped, amid prose; its words strewn over a text."""
    def wrapped(text, n):
        w = text.split()
        return "\n * ".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    rows, r = [], random.Random(11)
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        rows.append((3 * k, f"{prose(30, 40 + k)}\n{wrapped(text, 2 + k % 9)}\n{prose(30, 60 + k)}"))
        w = text.split()
        w[len(w) // 2:len(w) // 2] = ["zz"] * (len(w) // 10 + k % 2)
        rows.append((3 * k + 1, wrapped(" ".join(w), 12)))
        strewn = [x for t in r.sample(text.split(), len(text.split()))
                  for x in (t, *prose(40, r.random()).split())]
        rows.append((3 * k + 2, " ".join(strewn)))
    rows += [(900, "All of it. " + prose(50, 80) + " rights " + prose(50, 81) + " reserved"),
             (901, prose(3000, 82) + "\nAll\nrights\nreserved"), (902, "all rights"), (903, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["id"]: x for x in license_scan.license_scan(spark, df).collect()}
    for i, text in rows:
        labels, best = brute.license_blocks(text, license_scan.TEMPLATES, 0.9)
        x = got[i]
        assert set(x["labels"]) == labels | set(x["base_labels"])
        assert {b["label"] for b in x["blocks"] or ()} == labels
        assert max((b["containment"] for b in x["blocks"] or ()), default=0) == best
    for k, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[3 * k]["labels"] and got[3 * k]["blocks"][0]["line"] >= 1
        assert not got[3 * k + 2]["blocks"]
    assert got[901]["labels"] == ["all-rights-reserved"] and got[901]["blocks"][0]["line"] == 1
    assert not got[900]["labels"] and not got[902]["labels"]


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(spark, docs, items).collect()
    want = brute.contamination([t for _, t in ROWS], ITEMS)
    same([(r["id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got],
         [(i, *w) for (i, _), w in zip(ROWS, want)])
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert any(w[2] == ["1", "2"] for w in want)
    assert decontaminate.contamination(spark, none, items).count() == 0
    clean = decontaminate.contamination(spark, docs, items.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r["n_hit"] for r in clean)


def test_proximity_allows_a_gap(spark):
    w = prose(10, 93).split()
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:5] + ["zz"] + w[5:])),
                                  (3, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    index = decontaminate.PositionalIndex(spark, docs, items)
    got = {r["id"]: r["shift"] for r in decontaminate.proximity(index, 2).collect()}
    assert got[1] == 0 and 3 not in got
    assert decontaminate.proximity(index, 0).where("id = 1").count() == 1


def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    from sparselm.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    want = sorted((-1 if i is None else i, *tok.encode(t or "", add_special_tokens=False).ids, 0)
                  for i, t in ROWS)
    rows = packing.pack(spark, docs, capacity=256, with_ids=True, rounds=20).collect()
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 256
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(placed) <= 1.05 * sum(map(len, want)) / 256 + 2
    # pieces of unrepeated documents join to the document again
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["start"], r["piece"], r["ids"]))
    for i, t in ROWS:
        if i not in (4, None):
            parts = sorted(by[i])
            assert [p for _, p, _ in parts] == list(range(len(parts)))
            assert sum((x for *_, x in parts), []) == [
                *tok.encode(t or "", add_special_tokens=False).ids, 0]
    assert sum(r["length"] for r in rows) == sum(len(w) - 1 for w in want)
    assert packing.pack(spark, none, capacity=256).count() == 0


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    center = r.normal(size=(6, 16))
    rows = []
    for k in range(150):
        v = center[k % 6] + r.normal(size=16) * r.choice([0.01, 0.1, 0.5])
        rows.append((k, int(k % 2), [float(x) for x in v]))
    v = rows[0][2]
    rows += [(200, 0, v), (201, 0, v), (201, 0, v), (202, 1, v), (203, None, v), (204, 0, None),
             (205, 0, [0.0] * 16), (206, 0, [float("nan")] * 16), (207, 0, [*v[:15], None]),
             (208, 0, [*v[:15], float("inf")]), (None, 0, v), (209, 0, v[:8]),
             (210, 0, [2 * x for x in v]), (211, 0, []), (212, 0, [-0.0] * 16)]
    df = spark.createDataFrame([(*x, "c") for x in rows],
                               "vec_id long, label int, embedding array<double>, cls string")
    out, links = embedding_dedup.near_vectors(spark, df.repartition(3))
    want = brute.near_vectors(rows, 0.98)
    same([(x["id"], x["n_links"], x["component_id"]) for x in out.collect()],
         [(i, *w) for (i, _, _), w in zip(rows, want)])
    assert links.where("cosine < 0.98").count() == 0
    assert embedding_dedup.near_vectors(spark, df.limit(0))[0].count() == 0


def test_secret_scan(spark, docs, none):
    got = secret_scan.find_secrets(docs, rules=secret_scan.BASE_RULES, mask="#").collect()
    want = [[(secret_scan.BASE_RULES[k].kind, s, e) for s, k, e in brute.secrets(t)] for _, t in ROWS]
    same([(r["row"]["doc_id"], [tuple(s) for s in r["spans"]]) for r in got],
         [(i, w) for (i, _), w in zip(ROWS, want)])
    assert any(len(w) > 3 for w in want)
    for r in got:
        assert set(r["row"].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", *CLASH}
        assert (r["masked"] is None) == (r["row"]["text"] is None)
        if not r["spans"]:
            assert r["masked"] == r["row"]["text"]
        else:
            assert not brute.secrets(r["masked"])
    assert secret_scan.masked("ab12cd", [(1, 0, 3), (2, 1, 4)], "#") == "a#cd"
    assert secret_scan.find_secrets(none).count() == 0


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    from sparselm.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS]
    for r in token_counts.token_counts(spark, docs).collect():
        at = r["context_limit"]
        assert r["n_docs"] == n.count(at) and r["n_longer"] == sum(x > at for x in n)
        assert r["total_tokens"] == sum(n) and r["truncated_tokens"] == sum(min(x, at) for x in n)
        assert r["tokens_within"] == sum(x for x in n if x <= at)
        assert abs(r["doc_share"] - sum(x <= at for x in n) / len(n)) < 1e-12
    assert token_counts.token_counts(spark, docs).count() == len(set(n))
    assert token_counts.token_counts(spark, none).count() == 0


def test_quality(spark, docs, none):
    texts = [(k, prose(60, 1000 + k) if k % 3 else " ".join([VOCAB[k]] * 60)) for k in range(240)]
    known = spark.createDataFrame(texts + ROWS, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(k, int(k % 3 > 0)) for k in range(240)] + [(3, 1), (500, None), (None, 1)],
        "doc_id long, quality int")
    model = quality.learn(known.where("doc_id >= 22 OR doc_id IS NULL"), quality.train_split(labels))
    got = {r["row"]["doc_id"]: r["score"] for r in quality.score(
        known.where("doc_id >= 22"), model, keep=["doc_id"]).collect()}
    held = [k for k in range(22, 240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 20
    assert all((got[k] >= quality.THRESHOLD) == (k % 3 > 0) for k in held)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    empty = [r["score"] for r in scored if not (r["row"]["text"] or "").strip()]
    assert abs(empty[0] - model.base) < 1e-9
    assert quality.score(none, model).count() == 0
    blank = quality.learn(none, labels)
    assert {r["score"] for r in quality.score(docs, blank).collect()} == {0.5}


def test_quality_sample_stays_off_the_driver(spark):
    import pyarrow as pa

    from sparselm.llm import textblock

    texts = [prose(60, 2000 + k) if k % 3 else " ".join([VOCAB[k % 300]] * 60) for k in range(900)]
    known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(900)],
                                   "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality.learn(known, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 900 * quality.FEATURES * 4        # less than the counts take
    counts = quality.gram_counts(*textblock.block(pa.array(texts), lower=False))
    order = np.lexsort(counts.T[:8])
    want = quality.Model.fit(counts[order], (np.arange(900) % 3 > 0)[order])
    assert model.vectors.shape == (900, quality.AXES) and model.base == want.base
    assert np.allclose(model.rarity, want.rarity)
    assert np.allclose(model.scores(counts[:50]), want.scores(counts[:50]), atol=1e-4)


def test_maxent_lm(spark, docs, none):
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    model, counts, n, v = maxent_lm.train(spark, docs.where(crc_mod5() != 1), F.floor(crc / 5),
                                          lexicon=100)
    got = maxent_lm.score_texts(spark, docs, model, counts, n, v).collect()
    want = brute.base_scores(ROWS)
    same([(r["id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got],
         [(i, w[1], w[2], round(w[4], 6)) for (i, _), w in zip(ROWS, want)])
    assert n == want[0][3] and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    model, counts, n, v = maxent_lm.train(spark, none, F.lit(0))
    bare = maxent_lm.score_texts(spark, docs, model, counts, n, v).collect()
    assert n == v == 0 and len(bare) == len(ROWS)
    assert all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in bare)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, docs, none, percent):
    got = minhash_dedup.near_duplicates(spark, docs, percent=percent).collect()
    want = brute.near_duplicates(ROWS, percent)
    same([(r["id"], r["n_shingles"], r["component_id"]) for r in got],
         [(i, *w) for (i, _), w in zip(ROWS, want)])
    if percent == 85:
        assert minhash_dedup.near_duplicates(spark, none).count() == 0


def test_near_duplicates_beyond_the_star_rounds(spark, monkeypatch):
    """A crowd of near copies: pivots, then the exact blocks, small here."""
    monkeypatch.setattr(minhash_dedup, "STAR_PIVOTS", (1,))
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 4)
    r = random.Random(9)
    rows = []
    for k in range(60):
        w = prose(150, 500 + k % 2).split()
        for at in r.sample(range(150), r.choice([1, 2, 3, 4])):
            w[at] = f"new{k}x{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["id"]: x["component_id"] for x in
           minhash_dedup.near_duplicates(spark, df, percent=85).collect()}
    want = {i: c for (i, _), (_, c) in zip(rows, brute.near_duplicates(rows, 85))}
    assert got == want
