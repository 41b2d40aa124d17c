import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewlens.operators import anomalies, scoring
from reviewlens.plans import reports


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("0", "I LOVE it, great!"), ("1", "terrible crash"), ("2", "nothing to say"), ("3", None)]
    return spark.createDataFrame(rows, "review_id string, review_text string")


def labels(df):
    return {r.review_id: (r.sentiment_label, round(r.sentiment_score, 4)) for r in df.collect()}


def test_lexicon(texts):
    found = labels(scoring.lexicon_scorer()(texts))
    assert found["0"] == ("Positive", 0.9526)  # 2 + 1 against 0
    assert found["1"] == ("Negative", 0.9526)
    assert found["2"] == found["3"] == ("Negative", 0.5)


def test_scores_map(texts):
    row = scoring.lexicon_scorer(weights={"love": 1.0})(texts).where("review_id = '0'").first()
    assert row.sentiment_scores["Positive"] == row.sentiment_score
    assert sum(row.sentiment_scores.values()) == pytest.approx(1.0)


def test_predictor(texts):
    def load():
        return lambda batch: np.array([[0.0, 2.0] if "love" in t else [1.0, 0.0] for t in batch])

    found = labels(scoring.predictor_scorer(load, batch_size=2)(texts))
    assert found["0"][0] == "Positive" and found["1"] == ("Negative", 0.7311)
    assert len(found) == 4


def test_pipeline(spark):
    train = spark.createDataFrame([("good good", 1.0), ("bad bad", 0.0)] * 5, "review_text string, label double")
    stages = [
        Tokenizer(inputCol="review_text", outputCol="w"),
        HashingTF(inputCol="w", outputCol="features", numFeatures=64),
        LogisticRegression(regParam=0.01),
    ]
    model = Pipeline(stages=stages).fit(train)
    rows = spark.createDataFrame([("0", "good"), ("1", "bad")], "review_id string, review_text string")
    scored = scoring.pipeline_scorer(model)(rows)
    assert scored.columns == ["review_id", "review_text", "sentiment_label", "sentiment_score", "sentiment_scores"]
    assert {k: v[0] for k, v in labels(scored).items()} == {"0": "Positive", "1": "Negative"}


def test_pipeline_in_a_session_that_has_observed_rows(spark):
    """The summary of the training held the session, whose observations cannot be sent to tasks."""
    seen = Observation("seen")
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3
    test_pipeline(spark)


def test_mismatch_report(spark):
    rows = [
        (0, "0", "a", "I love this great app", 1.0),
        (1, "1", "a", "terrible awful crash again", 5.0),
        (2, "2", "a", "great fun great app", 5.0),
        (3, "3", "a", "too short", 5.0),
        (4, "4", "a", "no rating here at all", None),
        (5, "5", "a", None, 2.0),
    ]
    df = spark.createDataFrame(
        rows, "seq long, review_id string, app_name string, review_text string, star_rating double"
    )
    report = reports.mismatch_report(df, scoring.lexicon_scorer("clean_text"))
    flags = {r.review_id: r.is_mismatch for r in reports.mismatch_table(report).collect()}
    assert flags == {"0": True, "1": True, "2": False}
    row = anomalies.mismatch_breakdown(report).first()
    assert (row.total, row.mismatches, row.high_rating_negative, row.low_rating_positive) == (3, 2, 1, 1)
    assert row.mismatch_pct == 66.7
    capped = reports.scorable_reviews(df, ("review_text", "star_rating"), max_rows=2)
    assert sorted(r.review_id for r in capped.collect()) == ["0", "1"]


def test_aspect_report(spark):
    rows = [(0, "0", "a", "It will crash, and the price is too high", 1.0), (1, "1", "a", "just four words here", 4.0)]
    df = spark.createDataFrame(
        rows, "seq long, review_id string, app_name string, review_text string, star_rating double"
    )
    found = reports.aspect_report(df, scoring.lexicon_scorer("clean_text"))
    assert found.columns == [
        "review_id", "app_name", "review_text", "clean_text", "star_rating", "aspect", "sentiment", "confidence",
    ]
    assert sorted((r.review_id, r.aspect) for r in found.collect()) == [("0", "Bugs"), ("0", "Pricing"), ("1", "General")]


def test_spam_report(spark):
    texts = ["same words in here", "same words in here", "ok", "spam spam spam spam", "a normal review text", None]
    df = spark.createDataFrame(
        [(str(i), "a", t, 3.0) for i, t in enumerate(texts)],
        "review_id string, app_name string, review_text string, star_rating double",
    )
    report = reports.spam_report(df)
    reasons = {r.review_id: r.flag_reason for r in reports.spam_table(report).collect()}
    assert reasons == {"0": "near_duplicate", "1": "near_duplicate", "2": "too_short", "3": "repetitive", "4": ""}
    row = anomalies.spam_breakdown(report).first()
    assert (row.total, row.spam, row.too_short, row.repetitive, row.near_duplicate, row.spam_pct) == (5, 4, 1, 1, 2, 80.0)
    assert reports.spam_table(report.drop("star_rating")).columns == ["review_id", "app_name", "review_text", "flag_reason", "is_spam"]


def test_empty_reports_keep_their_schema(spark, raw):
    none = raw.where(F.lit(False))
    assert reports.mismatch_report(none, scoring.lexicon_scorer()).count() == 0
    assert anomalies.mismatch_breakdown(reports.mismatch_report(none, scoring.lexicon_scorer())).first().mismatch_pct == 0.0
