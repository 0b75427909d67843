"""Rules beyond the base, votes, what travels to Python, and workers that do not
have this package."""

import os
import random
import re
import subprocess
import sys
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparselm.llm import quality, secret_scan, textblock
from tests.conftest import ROOT, TESTDATA

URL = re.compile(r"[a-z][a-z0-9+.-]+://[^\s:/@]+:[^\s:/@]+@")


def _added(texts):
    scanner = secret_scan._Scanner(secret_scan.RULES)
    n = len(secret_scan.BASE_RULES)
    return [[(secret_scan.RULES[k].kind, a, b) for a, k, b in spans if k >= n]
            for spans in scanner.scan(pa.array(texts))]


def _by_expression(text):
    out = []
    for rule in secret_scan.MORE_RULES:
        expr = URL if rule.kind == "url_login" else re.compile(rule.pattern)
        out += [(m.start(), rule.kind, m.end()) for m in expr.finditer(text)]
    kinds = [r.kind for r in secret_scan.RULES]
    return [(k, a, b) for a, k, b in sorted(out, key=lambda x: (x[0], kinds.index(x[1]), x[2]))]


def test_added_rules_equal_their_expressions():
    r = random.Random(4)
    parts = ["https://", "://", "u:", "p@", "a1+.-", " ", "/", ":", "@", "ghp_", "x" * 40, "A1b2" * 12,
             "xoxb-", "AIza", "sk_live_", "eyJ", ".", "Bearer ", "bearer ", "-----BEGIN ", "RSA ",
             "PRIVATE KEY-----", "é", "Q_z-9" * 8, "s3", "1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    texts += ["eyJ" + "a" * 8 + ".eyJ" + "b" * 9 + "." + "c_" * 5]
    texts += ["https://user:" + "t" * 400 + "@host", "", "x" * 5000 + "://" + "y" * 5000 + ":z@"]
    got = _added(texts)
    assert got == [_by_expression(t) for t in texts]
    assert {k for g in got for k, _, _ in g} == {x.kind for x in secret_scan.MORE_RULES}
    assert got[-3] == [("url_login", 0, 414)]


def test_scores_are_the_votes_of_the_nearest():
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdeé ") for _ in range(9)) for _ in range(12))
             for _ in range(90)] + ["", "ab"]
    counts = quality.gram_counts(*textblock.block(pa.array(texts), lower=False))
    labels = np.array([i % 3 == 0 for i in range(60)], dtype=float)
    m = quality.Model.fit(counts[:60], labels)
    got = m.scores(counts)
    for i, c in enumerate(counts):
        if not c.any():
            assert got[i] == pytest.approx(m.base)
            continue
        x = np.log1p(c.astype(float)) * m.rarity
        z = (x / np.linalg.norm(x)) @ m.axes
        sims = sorted(((float(v @ z) / np.linalg.norm(z), k) for k, v in enumerate(m.vectors)),
                      reverse=True)[:quality.NEIGHBOURS]
        w = [max(s, 1e-3) ** quality.POWER for s, _ in sims]
        want = sum(a * labels[k] for a, (_, k) in zip(w, sims)) / sum(w)
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_a_slice_holds_its_own_bytes_only():
    texts = pa.array(["x" * 1000] * 5000)
    part = texts.slice(4990, 5)
    data, off = textblock.block(part)
    assert len(data) == 5000 and off.tolist() == [0, 1000, 2000, 3000, 4000, 5000]
    big = pa.RecordBatch.from_arrays([pa.array(["a" * (3 << 20), None, "b"])], names=["text"])
    assert sum(s.num_rows for s in textblock.text_slices(big, "text")) == 3
    many = pa.RecordBatch.from_arrays([pa.array(["a" * (1 << 20)] * 9)], names=["text"])
    assert max(s.num_rows for s in textblock.text_slices(many, "text")) <= 2


def test_stages_send_a_text_once(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a password = abcdefghijklmnop", 30, "x")],
                                 "doc_id long, text string, n_chars long, masked string")
    out = P.mask_secrets(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(text") == 1 and "MapInArrow" not in plan
    row = out.first()
    assert row["text"] == "a [SECRET]" and row["n_chars"] == 10 and row["masked"] == "x"


def test_a_text_beyond_one_slice(spark):
    from sparselm.llm import personal_data

    text = "plain words é " * 250000 + "https://user:" + "t" * 300 + "@h a@b.de"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r["row"]["doc_id"]: r["spans"] for r in secret_scan.find_secrets(docs).collect()}
    assert [(s["kind"], text[s["start"]:s["end"]][:13]) for s in rows[1]] == [
        ("url_login", "https://user:")] and rows[2] == []
    masked = docs.select("doc_id", secret_scan.masked_or_null(F.col("text")).alias("m")).collect()
    assert {r["doc_id"]: r["m"] and r["m"][-16:] for r in masked} == {1: "é [SECRET]h a@b.de"[-16:], 2: None}
    found, _ = personal_data.find_personal_data(spark, docs)
    assert {r["row"]["doc_id"]: len(r["spans"]) for r in found.collect()}[1] >= 1


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from sparselm.session import get_session
spark = get_session("local[2]", shuffle_partitions=2)
from sparselm.llm import catalog
for name in ("op8_quality", "op9_maxent_lm", "op13_hard_negatives"):
    print(name, catalog.QUERIES[name](spark, {data!r}).count())
"""


@pytest.mark.skipif(not os.path.exists(f"{TESTDATA}/sf0.001"), reason="no test tables")
def test_workers_need_no_copy_of_the_package():
    """Started elsewhere, without the package on the workers' path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, data=f"{TESTDATA}/sf0.001")],
        cwd=tempfile.mkdtemp(prefix="sparselm-elsewhere-"), env=env, capture_output=True,
        text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "op13_hard_negatives" in done.stdout
