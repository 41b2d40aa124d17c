import math
from collections import Counter

import pytest

from reviewlens.operators.naive_bayes import fit_naive_bayes, predict_naive_bayes

TRAIN = [
    ("1", "good good match", "p"),
    ("2", "nice people good chat", "p"),
    ("3", "bad app crash", "n"),
    ("4", "crash again and again", "n"),
    ("5", None, "n"),
    ("6", "", "n"),
    ("7", "unlabelled words", None),
]
TEST = [("a", "good chat"), ("b", "crash bad"), ("c", "nothing known"), ("d", None), ("e", "good crash people and")]
SCHEMA = "review_id string, text string, label string"


def plain(train, test, most):
    """The same by dictionaries."""
    rows = [(Counter((t or "").split()), c) for _, t, c in train if c is not None]
    totals, df = Counter(), Counter()
    for words, _ in rows:
        totals.update(words)
        df.update(words.keys())
    terms = sorted(totals, key=lambda w: (-totals[w], w))[:most]
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in terms}

    def unit(words):
        weights = {w: n * idf[w] for w, n in words.items() if w in idf}
        size = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / size for w, x in weights.items()}

    classes = sorted({c for _, c in rows})
    mass = {c: Counter(dict.fromkeys(terms, 1.0)) for c in classes}
    for words, c in rows:
        for w, x in unit(words).items():
            mass[c][w] += x
    prior = {c: math.log(sum(k == c for _, k in rows) / len(rows)) for c in classes}
    chance = {c: {w: math.log(mass[c][w] / sum(mass[c].values())) for w in terms} for c in classes}
    result = {}
    for key, text in test:
        words = unit(Counter((text or "").split()))
        scores = {c: prior[c] + sum(x * chance[c][w] for w, x in words.items()) for c in classes}
        whole = sum(math.exp(s) for s in scores.values())
        result[key] = (max(classes, key=lambda c: scores[c]), {c: math.exp(s) / whole for c, s in scores.items()})
    return chance, result


@pytest.mark.parametrize("most", [3, 100])
def test_model_and_predictions_equal_plain_sums(spark, most):
    model = fit_naive_bayes(spark.createDataFrame(TRAIN, SCHEMA), max_features=most)
    chance, expected = plain(TRAIN, TEST, most)
    got = {(r["class"], r.term): r.log_probability for r in model.collect()}
    assert got == {(c, w): pytest.approx(x) for c, row in chance.items() for w, x in row.items()}
    guessed = predict_naive_bayes(model, spark.createDataFrame(TEST, "review_id string, text string")).collect()
    assert {r.review_id: r.prediction for r in guessed} == {k: c for k, (c, _) in expected.items()}
    for r in guessed:
        assert {p["class"]: p.probability for p in r.probabilities} == pytest.approx(expected[r.review_id][1])


def test_no_rows_give_no_model(spark):
    assert fit_naive_bayes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_scores_go_to_the_first_class(spark):
    rows = [("1", "same words", "x"), ("2", "same words", "b")]
    model = fit_naive_bayes(spark.createDataFrame(rows, SCHEMA))
    row = predict_naive_bayes(model, spark.createDataFrame([("q", "same")], "review_id string, text string")).first()
    assert row.prediction == "b" and [p.probability for p in row.probabilities] == pytest.approx([0.5, 0.5])
