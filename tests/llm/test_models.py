from __future__ import annotations

import zlib

import numpy as np
import pytest

from tessel.llm import quality_model, queries, toxicity
from tessel.llm.linear import FTRL, Sample


def held_out(spark, folder, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.queries()[name](spark, folder).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    return [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def auc(rows):
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


LARGER = "/root/testdata/sf0.1"


def test_quality_on_held_out(spark):
    rows = held_out(spark, LARGER, "op10_quality_model", "quality")
    assert auc(rows) > 0.98 and np.mean([p == y for y, _, p in rows]) > 0.97
    assert np.mean([p for y, _, p in rows if y]) > 0.99  # clean documents stay


def test_toxicity_on_held_out(spark):
    rows = held_out(spark, LARGER, "op7_toxicity", "toxic")
    assert auc(rows) > 0.94
    assert np.mean([p for y, _, p in rows if y]) > 0.9 and np.mean([p for y, _, p in rows if not y]) < 0.01


def test_counterfactuals_take_the_weight_from_identity_terms():
    """Texts in which a group is named mostly when they are abusive."""
    rng, words = np.random.default_rng(0), [f"word{k}" for k in range(60)]
    sample = []
    for k in range(600):
        y = int(k % 3 == 0)
        own = list(rng.choice(words, 12))
        if rng.random() < (0.7 if y else 0.05):
            own.append("gay")
        if y and rng.random() < 0.8:
            own.append("scumbag")
        sample.append((y, toxicity.features(" ".join(own).encode())))
    neutral, plain = b"my gay friend wrote word1 word2 and word3 today", b"my good friend wrote word1 word2 and word3 today"
    gaps, abusive = [], []
    for penalty in (0.0, 1.0):
        scorer = toxicity.Scorer(toxicity.fit_rows(Sample.of(sample), penalty))
        gaps.append(scorer.logit(neutral) - scorer.logit(plain))
        abusive.append(scorer.logit(b"word1 word4 scumbag word9") - scorer.logit(b"word1 word4 river word9"))
    assert gaps[0] > 1 and abs(gaps[1]) < 0.25 * gaps[0] and abusive[1] > 1


@pytest.mark.parametrize("times", [1, 3])
@pytest.mark.parametrize("term", ["muslim", "transgender"])
def test_counterfactuals_take_the_weight_from_stems_too(term, times):
    """As above, with terms that have prefixes and stand several times in a text."""
    rng, words = np.random.default_rng(0), [f"word{k}" for k in range(60)]
    sample = []
    for k in range(600):
        y = int(k % 3 == 0)
        own = list(rng.choice(words, 12))
        if rng.random() < (0.7 if y else 0.05):
            own += [term] * times
        if y and rng.random() < 0.8:
            own.append("scumbag")
        sample.append((y, toxicity.features(" ".join(own).encode())))
    gaps = []
    for penalty in (0.0, 1.0):
        scorer = toxicity.Scorer(toxicity.fit_rows(Sample.of(sample), penalty))
        gaps.append(scorer.logit(f"my {term} friend wrote word1 word2 and word3 today".encode()) - scorer.logit(b"my good friend wrote word1 word2 and word3 today"))
        abusive = scorer.logit(b"word1 word4 scumbag word9") - scorer.logit(b"word1 word4 river word9")
    assert gaps[0] > 1 and abs(gaps[1]) < 0.25 * gaps[0] and abusive > 1


def test_swap_takes_all_features_of_a_term_as_often_as_it_stands():
    size, at = toxicity.features(b"a muslim and a muslim")
    held = [(b, int((at == b).sum())) for b in np.unique(at).tolist() if b in toxicity.BY_BUCKET]
    for seed in range(5):
        drawn = toxicity.IDENTITY[np.random.default_rng(seed).integers(len(toxicity.IDENTITY), size=1)[0]]
        want = dict.fromkeys([*toxicity.buckets(b"muslim"), *drawn], 0)
        for b in toxicity.buckets(b"muslim"):
            want[b] += 2
        for b in drawn:
            want[b] -= 2
        changed, change = toxicity.swap(held, np.random.default_rng(seed))
        assert dict(zip(changed.tolist(), change.tolist(), strict=True)) == {b: n for b, n in want.items() if n}


def test_scoring_equals_brute_force():
    rng = np.random.default_rng(3)
    w = rng.normal(size=quality_model.BUCKETS + 1).astype(np.float32)
    for t in (b"", b"One two two ###\n42 |", "é ß É".encode()):
        at = quality_model.features(t)
        want = float(w[-1]) + (quality_model.SCALE * sum(float(w[i]) for i in at) / len(at) if len(at) else 0)
        assert quality_model.probabilities([t], w)[0] == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-4)


def test_ftrl_equals_the_formula():
    m = FTRL(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = 0.0
    for y in (1.0, 0.0, 1.0, 1.0):
        w = 0.0 if abs(z) <= 0.1 else -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.5 + 0.2)
        bias = m.weights(np.array([4]))[0]
        g = (1 / (1 + np.exp(-(2 * w + bias))) - y) * 2
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5
        z, n = z + g - sigma * w, n + g * g
        m.learn(np.array([1]), np.array([2.0]), y)
        assert m.z[1] == pytest.approx(z) and m.n[1] == pytest.approx(n)


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_odd_rows(spark, odd_documents, no_documents, module):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    w = module.fit(odd_documents, labels)
    rows = module.score(odd_documents, w).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score(no_documents, w).collect() == []
    none = module.fit(no_documents, labels.limit(0))
    assert {r.score for r in module.score(odd_documents, none).collect()} == {0.5}


def test_keep(spark, odd_documents):
    kept = quality_model.keep(odd_documents, np.zeros(quality_model.BUCKETS + 1, np.float32), 0.5)
    assert kept.schema == odd_documents.schema and kept.count() == odd_documents.count()
    assert quality_model.keep(odd_documents, np.zeros(quality_model.BUCKETS + 1, np.float32), 0.6).count() == 0
