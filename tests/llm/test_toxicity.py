from __future__ import annotations

import random

import numpy as np
import pytest

from cohortwise.llm import toxicity

CLEAN = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "été", "größe"]
BAD = ["grumble", "Snarl", "growler"]


@pytest.fixture
def corpus(spark, documents):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(CLEAN) + rng.choice(["", ".", ",", "!"]) for _ in range(rng.randint(5, 80))]
        n = rng.choice([0, 0, 0, 1, 3, 6])
        for _ in range(n):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD) + rng.choice(["", ".", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(n > 0), n))
    return documents(rows), spark.createDataFrame([(i, t) for i, t, _ in labels if i < 400], "doc_id long, toxic int"), {i: n for i, _, n in labels}


def test_held_out_documents(corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(labels, docs)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if i >= 400]
    assert np.mean([(found[i].p_toxic >= 0.5) == (truth[i] > 0) for i in held]) > 0.98
    assert (np.diff(model.cuts) > 0).all()
    mean = [np.mean([found[i].expected_severity for i in held if truth[i] == n]) for n in (0, 1, 3, 6)]
    assert mean == sorted(mean) and mean[0] < 0.2 and mean[3] > mean[1] + 0.1
    assert all(abs(r.expected_severity) <= 3 and 0 <= r.p_toxic <= 1 for r in found.values())


def test_ordinal_fit_finds_shared_weights():
    rng = np.random.default_rng(0)
    n, w, cuts = 6000, np.array([2.0, -1.0, 0.5]), np.array([-0.5, 1.0, 2.5])
    x = rng.random((n, 3)) < 0.4
    y = (x @ w + rng.logistic(size=n))[:, None] > cuts[None, :]
    rows, features = np.nonzero(x)
    got_w, got_cuts = toxicity.fit_ordinal(rows, features, y.sum(axis=1), 3, 4, l2=0.01)
    assert np.allclose(got_w, w, atol=0.15) and np.allclose(got_cuts, cuts, atol=0.15)


def test_rows_of_all_kinds(spark, corpus, documents):
    docs, labels, _ = corpus
    model = toxicity.fit(labels.union(spark.createDataFrame([(None, 1), (3, None), (1, 0), (1, 0), (99_999, 1)], labels.schema)), docs)
    odd = [(None, None), (1, ""), (2, "snarl " * 200_000), (2, "snarl"), (2, "snarl"), (3, "\u0000 é")]
    frame = documents(odd).selectExpr("*", "1 as p_toxic", "2 as label", "3 as row")
    found = toxicity.score(frame, model).collect()
    assert len(found) == 6 and found[0].asDict().keys() >= {"doc_id", "text", "p_toxic", "label", "row"}
    assert all((r.p_toxic > 0.5) == bool(r.text and "snarl" in r.text) for r in found)
    assert toxicity.score(documents([]), model).count() == 0


def test_without_toxic_or_clean_examples(spark, corpus):
    docs, labels, _ = corpus
    for some in (labels.where("toxic = 0"), labels.where("toxic = 1"), labels.limit(0)):
        scored = toxicity.score(docs, toxicity.fit(some, docs))
        assert scored.where("p_toxic >= 0.5 or severity_grade > 0").count() == 0
    assert toxicity.fit(labels, docs.limit(0)).features.size == 0
