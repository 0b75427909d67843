"""The numpy parts, each against the definition."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparselm.llm import maxent_lm, packing, quality, suffix_array, textblock, tokens, windows
from sparselm.llm.secret_scan import RULES
from sparselm.llm.superminhash import band_keys, signatures
from sparselm.llm.trigrams import TrigramIndex, slot_table, trigram_query, trigrams_in
from tests.llm import brute

TEXTS = ["The quick brown fox jumps over the lazy dog", "", None, "a", "two words",
         "É été ÀB\tc\nd  e", "the quick brown fox jumps over the lazy dog",
         "x " * 50, "word " * 4]


def test_words_and_shingles_match_the_definition():
    data, off = textblock.block(pa.array(TEXTS))
    h, d = textblock.word_hashes(data, off)
    want = [(w, i) for i, t in enumerate(TEXTS) for w in brute.spaced_words(t)]
    assert d.tolist() == [i for _, i in want]
    ids = {}
    for x, (w, _) in zip(h.tolist(), want):
        assert ids.setdefault(w, x) == x
    assert len(set(ids.values())) == len(ids)
    s, sd = textblock.shingle_hashes(h, d, len(TEXTS))
    assert np.bincount(sd, minlength=len(TEXTS)).tolist() == [len(brute.shingles(t)) for t in TEXTS]
    assert s[sd == 0].tolist() == s[sd == 6].tolist()       # equal but for case


def test_text_slices_hold_every_row():
    big = pa.record_batch([pa.array(["a" * 3_000_000, None, "b", "c" * 2_500_000, "", "d"])],
                          names=["text"])
    parts = list(textblock.text_slices(big, "text"))
    assert len(parts) > 1
    assert [x for p in parts for x in p.column(0).to_pylist()] == big.column(0).to_pylist()


def test_superminhash_estimates_jaccard_and_spreads_ranks():
    rng = np.random.default_rng(1)
    m, err = 64, []
    for j in (0.3, 0.6, 0.9):
        for _ in range(60):
            n = 200
            both = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - both:2 * n - both])
            sig = signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2, m)
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            err.append((sig[0] == sig[1]).mean() - real)
    assert abs(np.mean(err)) < 0.01
    # a set smaller than the signature: ranks of one element are a permutation
    one = signatures(np.array([12345], np.uint64), np.array([0]), 1, m)
    assert sorted((one[0] >> 24).tolist()) == list(range(m))
    keys = band_keys(np.concatenate([one, one]), 8)
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == 8


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_two_stage_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(60):
        n = rng.randint(1, 120)
        t = bytes(rng.randrange(97, 97 + letters) for _ in range(n))
        chosen, kind = suffix_array.closed_under_induction(
            np.frombuffer(t, np.uint8), np.array([0]), np.array([n - 1]))
        assert [bool(k) for k in kind] == [t[i:] < t[i + 1:] for i in range(n)]
        order = suffix_array.two_stage_order(t, chosen, kind, 200)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:])
        common = suffix_array.adjacent_common_prefixes(t, order, 30)
        for a, b, c in zip(order, order[1:], common[1:]):
            k = 0
            while k < 30 and max(a, b) + k < n and t[a + k] == t[b + k]:
                k += 1
            assert c == k


def test_window_blocks_cover_every_window_once():
    rng = random.Random(4)
    length = 400
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (0, 399, 400, 1500, 3000)]
    texts += [texts[3][200:1400], "ab" * 700]
    data, off = textblock.block(pa.array(texts), lower=False)
    hasher = textblock.RangeHasher(data)
    text, ref, first, last, core, hull = windows.window_blocks(data, off, length, hasher)
    starts = np.concatenate([np.arange(r - f, r - x + 1) for r, f, x in zip(ref, first, last)])
    want = np.concatenate([np.arange(off[i], off[i + 1] - length + 1) for i in range(len(texts))
                           if off[i + 1] - off[i] >= length])
    assert sorted(starts.tolist()) == want.tolist()
    # equal windows lie at the same place of blocks of equal core
    place = {}
    for r, f, x, c in zip(ref, first, last, core):
        for s in range(r - f, r - x + 1):
            w = data[s:s + length].tobytes()
            assert place.setdefault(w, (c, r - s)) == (c, r - s)


def test_token_units_encode_like_the_tokenizer():
    from tokenizers import Tokenizer

    odd = ["", "a  b   c\n d \n\ne  ", "<|endoftext|> x<|endoftext|>y", " lead", "trail ", None,
           "a\x1c b", "é \xa0 à b\xa0 c", "don't  can't 12 34,,, !!", "日 本 語 テ", "\n", "   ",
           "x÷, é, ×, a…, ''s a|b", "ab\ncd.\nEf\n\ng \nh", "w " * 3000]
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in odd]
    enc = tokens.Encoder(tokens.default_tokenizer(), cache_units=20)
    for _ in range(3):                                  # the cache overflows
        ids, off = enc.encode(pa.array(odd, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_trigram_queries_never_miss():
    samples = {"assign": "PassWord = 'abcdefghijkl'", "access": "AKIA" + "A1" * 8,
               "hex": "0123456789abcdef", "private_key": "-----BEGIN RSA PRIVATE KEY-----",
               "github": "ghp_" + "a" * 36, "slack": "xoxb-1234567890",
               "google": "AIza" + "b" * 35, "stripe": "sk_live_" + "c" * 16,
               "jwt": "eyJabcdefgh.eyJabcdefgh.abcdefgh", "bearer": "Bearer " + "d" * 20,
               "url_login": "https://me:pw@host"}
    rng = random.Random(2)
    for rule in RULES:
        assert re.search(rule.pattern, samples[rule.kind])
        texts = ["".join(rng.choice("abk ey_") for _ in range(rng.randint(0, 40))) for _ in range(20)]
        at = rng.randrange(20)
        texts[at] = texts[at][:5] + samples[rule.kind] + "zz"
        query = trigram_query(rule.pattern)
        slot, number = slot_table(trigrams_in(query))
        index = TrigramIndex(*textblock.block(pa.array(texts)), slot, len(number))
        got = index.matching(query, number).tolist()
        assert at in got
        assert set(i for i, t in enumerate(texts) if re.search(rule.pattern, t)) <= set(got)
    assert trigram_query("[0-9a-f]+") is None           # scanned in full


@pytest.mark.parametrize("seed", [0, 1])
def test_packing_plan_is_exact_and_tight(seed):
    rng = np.random.default_rng(seed)
    demand = np.zeros(513, dtype=np.int64)
    np.add.at(demand, rng.integers(1, 513, 4000), 1)
    demand[512] = 17
    plan = packing.plan_packing(demand, 512, rounds=40)
    held = np.zeros_like(demand)
    for conf, times in plan:
        assert times > 0 and sum(k * n for k, n in conf.items()) <= 512
        for k, n in conf.items():
            held[k] += n * times
    assert (held == demand).all()
    least = -(-int((demand * np.arange(513)).sum()) // 512)
    # pieces above half a sequence never share one
    least = max(least, int(demand[257:].sum()) + -(-int(demand[256]) // 2))
    assert sum(t for _, t in plan) <= 1.01 * least
    assert sum(x for _, x in packing.solve_configurations(demand, 512, rounds=40)) > 0
    assert packing.plan_packing(np.zeros(513, np.int64), 512) == []


def test_quality_counts_do_not_cross_texts():
    t = ["abc", "", "d", "abcabc", "x x x"]
    whole = quality.gram_counts(*textblock.block(pa.array(t), lower=False))
    alone = [quality.gram_counts(*textblock.block(pa.array([x]), lower=False))[0] for x in t]
    assert np.allclose(whole, alone)
    assert whole[0, :quality.GRAMS].sum() == 1 and whole[4, -1] == 2


def test_gradient_steps_learn_a_context():
    rng = np.random.default_rng(0)
    word = rng.integers(1, 50, 20_000).astype(np.uint64)
    word[1::2] = word[::2] + np.uint64(100)             # follows from the word before
    doc = np.zeros(len(word), np.int64)
    lexicon, counts = np.unique(word, return_counts=True)
    model = maxent_lm.initial_model(lexicon, counts, len(word))
    at, known = model.lookup(word)
    assert known.all()
    before = maxent_lm.log_probabilities(model, word, doc).mean()
    seen = np.zeros(len(model.weights), np.float32)
    maxent_lm.gradient_steps(model.weights, seen, model.bias, maxent_lm.contexts(word, doc),
                             model.classes(at, known))
    assert maxent_lm.log_probabilities(model, word, doc).mean() > before + 0.5
    # the classes of any context sum to 1
    z = maxent_lm._logits(model.weights, model.bias, maxent_lm.contexts(word, doc)[:5])
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(p.sum(axis=1), 1)
