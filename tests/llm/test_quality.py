"""The factorisation machine against explicit pairs, its gradients, and held-out accuracy."""

from zlib import crc32

import numpy as np
import pytest

from cohortline.llm import quality
from cohortline.llm.common import table
from tests.llm.odd import odd_docs, odd_rows

DATA = "/root/testdata/sf0.01"


def small_model():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["ab", "cd", "efg", "h", "!!", "x1"], rng.integers(0, 9))) for _ in range(30)]
    texts += ["", "a\nb\na", "ÄÖ 中文 😀", "\x00 \t", "x" * 5000]
    told = [len(t) for t in texts[:-2]] + [None, 7]
    model = quality.Model(quality.Inputs(texts, told, {}).stats)
    model.weight = rng.standard_normal(model.size)
    model.vector = rng.standard_normal((model.size, quality.RANK))
    model.bias = 0.3
    return model, model.rows(quality.Inputs(texts, told, {})), texts, told


def test_linear_time_equals_all_pairs():
    model, (ids, values, cuts), _, _ = small_model()
    got = model.logits(ids, values, cuts)
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        want = model.bias + sum(model.weight[i] * x for i, x in zip(ids[lo:hi], values[lo:hi]))
        for p in range(lo, hi):
            for q in range(p + 1, hi):
                want += model.vector[ids[p]] @ model.vector[ids[q]] * values[p] * values[q]
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_gradients():
    model, rows, texts, _ = small_model()
    rng = np.random.default_rng(5)
    target, cost = rng.integers(0, 2, len(texts)).astype(float), rng.uniform(0.5, 2, len(texts))

    def loss():
        logit = model.logits(*rows)
        return float((cost * (np.logaddexp(0, logit) - target * logit)).sum() / cost.sum())

    of_bias, ids, of_weight, of_vector = model.gradients(*rows, target, cost)
    step = 1e-5
    checks = [(model.vector, (i, f), of_vector[k, f]) for k, i in enumerate(ids[:6]) for f in (0, 5)] + [(model.weight, i, of_weight[k]) for k, i in enumerate(ids[:6])]
    for param, at, got in checks:
        old = param[at]
        param[at] = old + step
        up = loss()
        param[at] = old - step
        down = loss()
        param[at] = old
        assert got == pytest.approx((up - down) / (2 * step), abs=1e-6)
    model.bias += step
    up = loss()
    model.bias -= 2 * step
    assert of_bias == pytest.approx((up - loss()) / (2 * step), abs=1e-6)


def test_a_score_depends_on_its_text_alone():
    model, _, texts, told = small_model()
    together = quality.Scorer(model).scores(texts, told)
    alone = [quality.Scorer(model).scores([t], [n])[0] for t, n in zip(texts, told)]
    assert np.allclose(together, alone, atol=1e-6)
    scorer = quality.Scorer(model)
    assert np.allclose(scorer.scores(texts[:3], told[:3]), alone[:3], atol=1e-6) and np.allclose(scorer.scores(texts, told), alone, atol=1e-6)


def test_held_out_accuracy_and_unread_columns(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = {r.doc_id: r for r in quality.score_texts(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    out = [(rows[i].predicted, y) for i, y in truth.items() if i in rows and rows[i].held_out]
    assert np.mean([p == y for p, y in out]) > 0.95
    for y in (0, 1):
        assert np.mean([p == y for p, t in out if t == y]) > 0.85
    # held-out labels, lang and source change nothing
    blind = quality.score_texts(docs.drop("lang", "source"), labels.where(~quality.held_out(labels.doc_id)))
    assert {r.doc_id: r.score for r in blind.collect()} == {i: r.score for i, r in rows.items()}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(30, 60)] + [(31, 0, "x"), (32, 7, "x"), (None, 1, "x"), (40, None, "x")], "doc_id long, quality int, text string")
    got = quality.score_texts(odd_docs(spark), labels).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(i) for i, _ in odd_rows())
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert quality.score_texts(odd_docs(spark, []), labels).collect() == []
    assert {r.score for r in quality.score_texts(odd_docs(spark), labels.limit(0)).collect()} == {0.0}
    one = labels.where("quality = 1 AND doc_id > 40")
    assert all(0 <= r.score <= 1 for r in quality.score_texts(odd_docs(spark), one).collect())


def test_cut():
    assert quality.best_cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 0.0, 1.0, 1.0])) == 1.5
    assert quality.best_cut(np.array([0.0, 1.0]), np.array([1.0, 1.0])) == 0.0
