"""Personal data, ranked search and hard negatives against brute force: nulls,
empty and long texts, ties, repeated rows, clashing names, empty tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparselm.llm import hard_negatives, personal_data, pii_labelers, ranked_search
from tests.llm import brute
from tests.llm.test_operators import CLASH, ITEMS, ROWS, prose

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BIG = " ".join(prose(400, 40 + i % 3) for i in range(1500))     # some 3 MB: beyond one slice


# ---------------------------------------------------------------- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_rules(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(
                      int(p) <= 255 for p in m.group().split(".")),
                  "card": 13 <= len(d) <= 19 and pii_labelers.luhn(d),
                  "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    "write to jane.doe+x@mail.example.com, or a@b.c.@d.e or @x.y or q@@r.s.t or u@v",
    "ip 10.0.0.1 and 1.2.3.4.5.6.7.8.9 and 300.1.1.1 and 000255.1.1.1 v1.2.3",
    "card 4532 0151-1283 0366 and 4532015112830367 and 5 5 and 1234567890123456789012",
    "call +49 (170) 123-4567. or +1 2 or +1 234 567 89 0 - ) and +44.20.7946.0958 x",
    "iban DE89 3704 0044 0532 0130 00 account; DE89370400440532013001",
    "Dear Mr. John Smith, regards Sabine Müller in January March",
    "jane (at) host (dot) com or call 0170 1234567 now",
    "é" * 20 + " 192.168.0.1 ñ +34 600 000 001", "9" * 5000, "1." * 4000, "@" * 3000, "+1" * 2000,
    "a" * 20000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", None, "",
]


@pytest.mark.parametrize("seed", range(3))
def test_base_rules_equal_the_expressions(seed):
    r = random.Random(seed)
    texts = [t for t in PII if t and len(t) < 6000]
    texts += ["".join(r.choice("a1@.+- ()25%") for _ in range(r.randint(1, 60)))
              for _ in range(3000)]
    for t in texts:
        got = [(pii_labelers.KINDS[k], a, b) for k, a, b in pii_labelers.base_spans(t)]
        assert got == base_rules(t), t


def test_votes_are_learned_without_labels():
    """Drawn votes of labelers of known reliability: EM finds them again."""
    r = np.random.Generator(np.random.PCG64(3))
    right = np.array([0.95, 0.9, 0.7, 0.6, 0.85, 0.75, 0.8])
    truth = r.random(20000) < 0.3
    speaks = r.random((20000, 7)) < 0.8
    agrees = r.random((20000, 7)) < right
    vote = np.where(speaks, np.where(agrees == truth[:, None], 1, -1), 0)
    counts = collections.Counter((0, pii_labelers.code(tuple(v))) for v in vote.tolist())
    known = personal_data.Reliabilities(counts, decisive=())
    assert abs(known.share[0] - 0.3) < 0.05
    table = known.table[0]
    for j in range(7):
        said = table[1, j, 2] / (table[1, j, 0] + table[1, j, 2])
        assert abs(said - right[j]) < 0.08
    p = np.array([known.posterior[0, pii_labelers.code(tuple(v))] for v in vote.tolist()])
    assert ((p > 0.5) == truth).mean() > 0.95
    assert pii_labelers.decoded(pii_labelers.code((1, 0, -1, 1, 1, 0, -1))) == (1, 0, -1, 1, 1, 0, -1)


@pytest.fixture(scope="module")
def pii(spark):
    texts = PII + [t for t in PII[:7] for _ in range(4)]
    texts.append(" ".join(["plain words"] * 130000) + " " + PII[0])      # beyond one slice
    return spark.createDataFrame(
        [(i % 20 if i % 9 else None, t, None, *[f"c{i}"] * len(CLASH)) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)
    ).repartition(3)


def test_personal_data(spark, pii):
    found, known = personal_data.find_personal_data(spark, pii)
    rows = found.collect()
    assert len(rows) == pii.count()
    kinds = collections.Counter()
    for r in rows:
        t = r["row"]["text"]
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == base_rules(t)
        order = [(pii_labelers.KINDS.index(s["kind"]), s["start"]) for s in r["spans"]]
        assert order == sorted(order)
        more = [s for s in r["spans"] if not s["base"]]
        for s in more:
            kinds[t[s["start"]:s["end"]]] += 1
            assert s["score"] >= personal_data.LEAST_SCORE
            assert all(s["end"] <= o["start"] or o["end"] <= s["start"]
                       for o in r["spans"] if o is not s)
    assert "DE89 3704 0044 0532 0130 00" in kinds and "jane (at) host (dot) com" in kinds
    assert "4532015112830367" not in kinds and "300.1.1.1" not in kinds
    assert set(known.share) <= set(range(6))
    empty, _ = personal_data.find_personal_data(spark, pii.limit(0))
    assert empty.count() == 0


def test_the_classifier_follows_the_posterior(spark, pii):
    """On the training table the weights order candidates as the votes do."""
    src = pii.select(F.struct("doc_id").alias("row"), "text")
    cands = src.mapInArrow(personal_data._candidate_pass, personal_data.T.StructType(
        [src.schema["row"], personal_data.T.StructField("cands", personal_data._CAND_SCHEMA)]))
    classes = cands.select(F.explode("cands").alias("c")).groupBy(
        "c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")).cache()
    counts = {(r["kind"], r["votes"]): r["n"] for r in classes.groupBy("kind", "votes").agg(
        F.sum("n").alias("n")).collect()}
    posterior = personal_data.Reliabilities(counts).posterior
    w = personal_data.train(classes, posterior, rounds=60)
    rows = classes.collect()
    p = np.array([posterior[r["kind"], r["votes"]] for r in rows])
    s = np.array([1 / (1 + math.exp(-w[r["features"]].sum())) for r in rows])
    n = np.array([r["n"] for r in rows])
    sure = abs(p - 0.5) > 0.4
    assert (n * ((s > 0.5) == (p > 0.5)))[sure].sum() / n[sure].sum() > 0.95


# ---------------------------------------------------------------- ranked search


def brute_search(docs, items, k=20):
    lower = lambda t: TERMS.findall((t or "").translate(brute.LOWER))
    tf = [collections.Counter(lower(t)) for _, t in docs]
    df = collections.Counter(x for c in tf for x in c)
    n_docs, n_terms = sum(1 for c in tf if c), sum(sum(c.values()) for c in tf)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = collections.Counter(lower(text))
        scores = []
        for (doc, t), c in zip(docs, tf):
            n, score = sum(c.values()), 0
            for x, r in asked.items():
                if c[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    m = 75 + (25 * n * n_docs) // n_terms
                    score += r * w * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else doc, -s))
    return out


DOCS = ROWS + [(100 + i, prose(15 + i % 40, 200 + i)) for i in range(300)] + [
    (500 + i, "same words here a_B 1") for i in range(40)] + [(900, BIG)]
QUERIES = ITEMS + [(30 + i, prose(12, 200 + 7 * i)) for i in range(12)] + [
    (50, "Same WORDS words"), (51, "nowhereatall"), (52, "same"), (3, None), (5, "one two three")]


@pytest.mark.parametrize("postings,block", [(1 << 20, 1 << 20), (500, 60)])
def test_ranked_search(spark, monkeypatch, postings, block):
    # functions travel by value: small shards are set where the tasks see them
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", postings)
    docs = spark.createDataFrame(
        [(i, t, *[f"c{k}"] * len(CLASH)) for k, (i, t) in enumerate(DOCS)],
        "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(4)
    items = spark.createDataFrame(QUERIES, "item_id long, text string").withColumn(
        "doc_id", F.lit("x")).withColumn("terms", F.lit(1))
    got = ranked_search.ranked_search(spark, docs, items, block_terms=block).collect()
    want = brute_search(DOCS, QUERIES)
    have = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    assert ranked_search.ranked_search(spark, docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(spark, docs, items.limit(0)).count() == 0


def test_pair_bounds_skip_and_never_lose():
    """Against full scoring on random postings; pairs skip at least as much as
    single maxima."""
    import pyarrow as pa

    r = np.random.Generator(np.random.PCG64(5))
    n, v = 400, 30
    w = ranked_search.Weights(n, n * 12, np.sort(r.integers(10, 9000, v))[::-1].copy())
    terms = [np.unique(r.integers(0, v, 12) * r.integers(0, 2, 12)) for _ in range(n)]
    b = pa.RecordBatch.from_pydict({
        "id": pa.array(range(n), pa.int64()), "tkey": pa.array(range(n), pa.int64()),
        "n": pa.array([12] * n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())),
        "counts": pa.array([r.integers(1, 4, len(t)) for t in terms], pa.list_(pa.int32()))})
    s = ranked_search.Shard(b, w)
    skipped = alone = 0
    for _ in range(40):
        asked = [(int(t), int(c)) for t, c in zip(r.permutation(v)[:9], r.integers(1, 3, 9))]
        full = np.zeros(n, np.int64)
        for t, c in asked:
            d, i = s.list(t)
            full[d] += c * i
        pairs = [tuple(asked[j:j + 2]) for j in range(0, 9, 2)]
        single = [[c * int(s.list(t)[1].max(initial=0)) for t, c in p] for p in pairs]
        bound = []
        for p, one in zip(pairs, single):
            both = set(s.list(p[0][0])[0]) & set(s.list(p[-1][0])[0])
            joint = [sum(c * int(i[d == x][0]) for t, c in p for d, i in [s.list(t)]) for x in both]
            bound.append(max([*one, *(joint if len(p) == 2 else [])]))
            assert bound[-1] <= sum(one)
        least = int(np.sort(full)[-20])
        at, score = ranked_search.search_shard(s, ranked_search.Query(pairs, bound), least)
        assert dict(zip(at.tolist(), score.tolist())) == {
            int(i): int(full[i]) for i in np.flatnonzero((full >= least) & (full > 0))}
        skipped += int(np.searchsorted(np.cumsum(np.sort(bound)), least))
        alone += int(np.searchsorted(np.cumsum(np.sort([sum(o) for o in single])), least))
    assert skipped >= alone


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows):
    use = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        use[(i, lab, tuple(math.floor(256 * x) for x in v))] = 1
    use = list(use)
    out = []
    for a in use:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b) for b in use
                  if b != a and len(b[2]) == len(a[2])]
        near = sorted((s, b[0]) for s, b in scored if b[1] == a[1])[:5]
        for ps, p in near:
            far = sorted((s, b[0]) for s, b in scored if b[1] != a[1]
                         and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(a[0], p, r, n, -ps, -s) for r, (s, n) in enumerate(far, 1)]
    return out


def vectors():
    r = random.Random(11)
    centre = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(900):
        c = centre[i % 12]
        rows.append((i, [round(x + r.gauss(0, .6), 2) for x in c], r.randint(0, 9)))
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], 3) for i in range(60)]          # ties
    rows += [(2000, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], 3)] * 3 + [(2100, [0.0] * 6, 1), (2101, [0.0] * 6, 1)]
    rows += [(3000, None, 1), (3100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 6, 1),
             (3200, [1.0] * 6, None), (3300, [float("nan")] * 6, 1), (3400, [float("inf")] * 6, 2),
             (3500, [1.0, 2.0], 1), (3501, [1.0, 2.5], 1), (3502, [1.0, 1.0], 2), (3600, [], 4)]
    return rows


@pytest.mark.parametrize("block", [16 << 20, 4000])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rows = vectors()
    names = ["q", "tag", "lab", "id", "anchor", "cluster", "batch", "block", "near"]
    src = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows],
                                "vec_id long, embedding array<double>, label int, "
                                + ", ".join(f"{c} string" for c in names)).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(spark, src.withColumn("label", label),
                                        F.col("vec_id") % 100 == 0)
    have = [tuple(r)[:6] for r in got.select("anchor_id", "positive_id", "rank", "negative_id",
                                             "positive_score", "negative_score").collect()]
    assert sorted(have) == sorted(brute_negatives(rows)) and len(have) > 200
    assert hard_negatives.hard_negatives(spark, src.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(spark, src, F.lit(False)).count() == 0


def test_the_walk_ends_early_and_stays_exact():
    r = np.random.Generator(np.random.PCG64(9))
    centre = r.standard_normal((8, 16))
    q = np.floor(256 * (centre[r.integers(0, 8, 30000)] + 0.05 * r.standard_normal((30000, 16))))
    q = q.astype(np.int64)
    side = {"id": np.arange(30000), "tag": np.zeros(30000, np.int64),
            "lab": r.integers(0, 3, 30000), "q": q}
    mine = np.flatnonzero(np.argmin(((q[:400, None, :] / 256 - centre[None]) ** 2).sum(2), 1) == 0)
    part = {c: v[mine] for c, v in side.items()}
    low = np.full((len(mine), 1), hard_negatives._NONE + 1)
    high = np.full((len(mine), 1), np.iinfo(np.int64).max)
    found, met = hard_negatives.walk(part, side, 5, low, high, True)
    assert met < len(mine) * 30000 / 2
    for a in range(len(mine)):
        s = q @ part["q"][a]
        ok = np.flatnonzero((side["lab"] == part["lab"][a]) & (side["id"] != part["id"][a]))
        want = ok[np.lexsort((ok, -s[ok]))[:5]]
        assert sorted(int(r_) for x, _, r_, _ in found if x == a) == sorted(want.tolist())
    big = {c: (v[:50] if c != "q" else v[:50] * 2 ** 20) for c, v in side.items()}
    s = hard_negatives._products(big["q"], big["q"])
    assert s.dtype == np.int64 and int(s[0, 1]) == sum(
        int(x) * int(y) for x, y in zip(big["q"][0], big["q"][1]))
