import random

import pytest

from reviewlens.operators import baselines, evaluation


def test_confusion_and_f1(spark):
    rows = [("p", "p")] * 6 + [("p", "n")] * 2 + [("n", "n")] * 1 + [("n", "p")] * 3
    df = spark.createDataFrame(rows, "label string, prediction string")
    cells = {(r.label, r.prediction): r["count"] for r in evaluation.confusion_matrix(df).collect()}
    assert cells == {("p", "p"): 6, ("p", "n"): 2, ("n", "n"): 1, ("n", "p"): 3}
    scores = {r["class"]: r for r in evaluation.class_scores(df).collect()}
    assert scores["p"].precision == pytest.approx(6 / 9) and scores["p"].recall == pytest.approx(6 / 8)
    assert (scores["n"].support, scores["n"].hits) == (4, 1)
    row = evaluation.accuracy_and_macro_f1(df).first()
    assert row.accuracy == pytest.approx(7 / 12)
    assert row.macro_f1 == pytest.approx((12 / 17 + 2 / 7) / 2)


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    scores = {r["class"]: r for r in evaluation.class_scores(df).collect()}
    assert (scores["b"].precision, scores["b"].f1) == (0.0, 0.0)


def direct_auc(rows):
    positive = [s for p, s in rows if p]
    negative = [s for p, s in rows if not p]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return wins / (len(positive) * len(negative))


@pytest.mark.parametrize("spread", [0.0001, 1.0, 1000.0])
def test_auc(spark, spread):
    rng = random.Random(3)
    rows = [(rng.random() < 0.3, round(rng.gauss(0, 1), 1) * spread) for _ in range(300)]
    df = spark.createDataFrame(rows, "is_positive boolean, score double")
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(direct_auc(rows))


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(True, 0.4), (True, 0.6)], "is_positive boolean, score double")
    assert evaluation.roc_auc(df).first().roc_auc is None


def test_baselines_learn_a_clear_signal(spark):
    rng = random.Random(5)
    filler = [f"word{i}" for i in range(50)]
    rows = []
    for i in range(200):
        good = i % 2 == 0
        words = rng.choices(filler, k=8) + (["wonderful", "great"] if good else ["awful", "crash"])
        rows.append((str(i), " ".join(words), 5.0 if good else 1.0))
    rows += [(f"neutral{i}", "word1 word2", 3.0) for i in range(10)] + [("none", None, 5.0)]
    df = spark.createDataFrame(rows, "review_id string, clean_text string, star_rating double")
    table = baselines.compare_baselines(df)
    metrics = {r.model: r for r in table.collect()}
    assert table.columns == ["model", "accuracy", "macro_f1", "roc_auc"]
    assert set(metrics) == {"Naive_Bayes", "Logistic_Regression", "LinearSVC"}
    assert all(r.accuracy == r.macro_f1 == r.roc_auc == 1.0 for r in metrics.values())


def test_tfidf_features_have_unit_length_and_shifted_idf(spark):
    df = spark.createDataFrame([("aa bb",), ("aa cc cc",)], "text string")
    model = baselines.fit_tfidf(df)
    vectors = [r.features for r in model.transform(df).collect()]
    assert all(v.norm(2) == pytest.approx(1.0) for v in vectors)
    # aa is in both texts (weight 1), bb in one (ln(3/2) + 1)
    first = sorted(v for v in vectors[0].values)
    assert first[1] / first[0] == pytest.approx(1.4054651)
