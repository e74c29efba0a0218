import math

import numpy as np
import pytest

from skilldemand.llm.lsa_vote import quality_scores
from skilldemand.llm.nnpu import FALSE_SHARE, nn_pu_scores, risk_gradient, standing_out


def plain_risk(weights, positive, unlabelled, prior):
    """The two parts of the risk, row by row: of positives, and of the unlabelled, corrected."""
    score = lambda row: 1 / (1 + math.exp(-sum(w * x for w, x in zip(weights, row))))
    plus = sum(1 - score(r) for r in positive) / len(positive)
    minus = sum(score(r) for r in unlabelled) / len(unlabelled)
    return prior * plus, minus - prior * sum(score(r) for r in positive) / len(positive)


@pytest.mark.parametrize("prior, below", [(0.1, False), (0.9, True)])
def test_gradient_against_differences_of_a_plain_risk(prior, below):
    rng = np.random.default_rng(5)
    positive = np.hstack([rng.random((7, 3)) < 0.8, np.ones((7, 1))]).astype(float)
    unlabelled = np.hstack([rng.random((11, 3)) < 0.2, np.ones((11, 1))]).astype(float)
    weights = np.array([1.0, 0.7, 1.2, -1.5])
    assert (plain_risk(weights, positive, unlabelled, prior)[1] < 0) == below

    def risk(at):
        first, rest = plain_risk(at, positive, unlabelled, prior)
        return -rest if below else first + rest

    step = 1e-5
    sides = [(weights + step * e, weights - step * e) for e in np.eye(4)]
    want = [(risk(up) - risk(down)) / (2 * step) for up, down in sides]
    assert np.allclose(risk_gradient(weights, positive, unlabelled, prior), want, atol=1e-8)


def plain_choice(texts, features):
    marks = [mark for mark, _ in texts]
    share = sum(marks) / len(marks)
    p = {}
    words = {w for _, have in texts for w in have}
    for w in words:
        t = sum(w in have for _, have in texts)
        a = sum(mark for mark, have in texts if w in have)
        if a and a / t > share:
            p[w] = -a * math.log(a / t / share)
            if a < t:
                p[w] -= (t - a) * math.log((1 - a / t) / (1 - share))
    order = sorted(p, key=lambda w: (p[w], w))[:features]
    fits = [k for k, w in enumerate(order) if p[w] <= math.log(FALSE_SHARE * (k + 1) / len(words))]
    return order[: fits[-1] + 1] if fits else []


@pytest.mark.parametrize("n_pos, n_rest, features", [(40, 160, 256), (40, 160, 5), (6, 30, 256), (3, 300, 256)])
def test_chosen_words_against_a_plain_loop(spark, n_pos, n_rest, features):
    rng = np.random.default_rng(n_pos + n_rest)
    texts = []
    for i in range(n_pos + n_rest):
        mark = int(i < n_pos)
        # words 0 to 7 mark the confirmed ones, the less the higher; the others are chance
        have = {w for w in range(8) if rng.random() < (0.9 - 0.1 * w if mark else 0.02 * w)}
        texts.append((mark, sorted(have | set(rng.integers(100, 400, 25).tolist()))))
    rows = [(2 * i + mark, mark, have) for i, (mark, have) in enumerate(texts)]
    seen = spark.createDataFrame(rows, "key long, mark int, words array<long>").repartition(3)
    got = standing_out(seen, n_pos, n_rest, features).tolist()
    assert got == plain_choice(texts, features)
    if n_pos == 40:
        assert set(range(4)) <= set(got) and sum(w >= 100 for w in got) <= 1


def test_nothing_stands_out_by_chance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 9 == 0), rng.integers(0, 3000, 40).tolist()) for i in range(300)]
    seen = spark.createDataFrame([(k, m, sorted(set(w))) for k, m, w in rows], "key long, mark int, words array<long>")
    assert not len(standing_out(seen, 34, 266, 256))
    assert not len(standing_out(seen.limit(0), 0, 0, 256))


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"plain words w{i % 17} v{i % 29}" + (" vile" if i % 5 == 0 else "")) for i in range(200)]
    rows += [(0, "another text of an id"), (5, None), (5, ""), (10, "vile vile"), (None, "vile")]
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 200, 2)], "doc_id long, toxic int")
    scores = []
    for ordered in (rows, rows[::-1]):
        docs = spark.createDataFrame(ordered, "doc_id long, text string").repartition(4)
        got = nn_pu_scores(docs, marks).collect()
        assert len(got) == len(rows)
        scores.append(sorted((r.doc_id or -1, round(r.score, 12), r.predicted) for r in got))
    assert scores[0] == scores[1]
    assert all(p == (i % 5 == 0) for i, _, p in scores[0] if i % 5 and i > 0)


def test_latent_space_is_not_fitted_by_the_driver(spark, monkeypatch):
    words = ["plain good words", "cheap cheap offer"]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} {i % 5}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")

    def fit(*_):
        raise AssertionError("the driver fits the space")

    monkeypatch.setattr(np.linalg, "eigh", fit)  # tasks have numpy's own
    found = {r.doc_id: r.predicted for r in quality_scores(docs, labels).collect()}
    assert found == {i: i % 2 for i in range(40)}
