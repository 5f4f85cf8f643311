"""Toxicity by sparse features over every term: scores against plain sums, rare words, held-out rows."""

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import toxicity

GOOD = "the quiet river runs under green bridges and people read long books beside warm stoves".split()
BAD = "idiot scum filth vile".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    out = []
    for i in range(240):
        body = [GOOD[j] for j in rng.integers(len(GOOD), size=60)]
        if i % 4 == 0:
            for at in rng.integers(60, size=1 + i // 4 % 12):
                body[at] = BAD[int(rng.integers(4))]
        if i == 0:
            body[5] = "zzrareslur"  # in one document only
        out.append((i, " ".join(body), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0 or i % 4], "doc_id long, toxic int").filter("doc_id % 8 <> 4")
    return toxicity.fit_toxicity(docs, labels)


def plain(model, text):
    """P(grade > k) term by term."""
    found = toxicity.words(text)
    total, n = 0.0, len(model.columns)
    for term, k in toxicity.terms(text).items():
        if term in model.columns:
            i = model.columns[term]
            total += model.weights[i] * np.log1p(k) + model.weights[n + i] * np.log1p(100 * k / max(1, len(found)))
    return 1 / (1 + np.exp(np.clip(model.thresholds - total, -40, 40)))


def test_scores_are_sums_over_all_terms(spark, rows, model):
    texts = [t for _, t, _ in rows[:40]] + [None, "", "unknown words", " ".join([rows[0][1]] * 300), rows[3][1], rows[3][1]]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, grade string, p_mild double")
    for r in toxicity.score_toxicity(docs, model).collect():
        over = plain(model, texts[r["doc_id"]])
        assert r["expected_severity"] == pytest.approx(over.sum(), abs=1e-5)
        assert r["toxic"] == bool(over[0] >= 0.5) and r["p_severe"] == pytest.approx(over[1], abs=1e-5)


def test_every_term_has_a_column(rows, model):
    used = Counter(t for i, text, _ in rows if (i % 2 == 0 or i % 4) and i % 8 != 4 for t in toxicity.terms(text))
    assert set(model.columns) == set(used) and b"zzrareslur" in model.columns
    i = model.columns[b"zzrareslur"]
    assert model.weights[i] > 0 and model.weights[i] != model.weights[model.columns[b"river"]]


def test_held_out_documents(spark, rows, model):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").filter("doc_id % 8 = 4 or doc_id % 4 = 1")
    got = toxicity.score_toxicity(docs, model).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in got)
    bad = {i: sum(w in BAD for w in t.split()) for i, t, _ in rows}
    severe = [bad[r["doc_id"]] for r in got if r["grade"] == 2]
    mild = [bad[r["doc_id"]] for r in got if r["grade"] == 1]
    assert np.mean(severe) > np.mean(mild)


def test_sparse_products_are_those_of_the_dense_matrix():
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(7, 11)) * (rng.random((7, 11)) < 0.3)
    x = toxicity.Sparse([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense], 11)
    w, g = rng.normal(size=11), rng.normal(size=7)
    assert np.allclose(x @ w, dense @ w, atol=1e-6) and np.allclose(g @ x, g @ dense, atol=1e-6)
    grade = np.array([0, 0, 1, 1, 2, 2, 0])
    for one, two in zip(toxicity.fit_ordinal(x, grade, 3, steps=60), toxicity.fit_ordinal(dense, grade, 3, steps=60)):
        assert np.allclose(one, two, atol=1e-4)
