"""Weakly supervised baseline classifiers on TF-IDF features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reviewlens.functions.rules import weak_label, weak_label_index
from reviewlens.functions.text import WORD
from reviewlens.operators.evaluation import accuracy_and_macro_f1, roc_auc
from reviewlens.operators.keys import stratified_split
from reviewlens.operators.scoring import without_summaries
from reviewlens.sources.scratch import materialise

MAX_FEATURES = 50_000

_ROWS_PER_PARTITION = 5_000


def training_rows(reviews: DataFrame, key: str = "review_id", text: str = "clean_text") -> DataFrame:
    """``(key, text, sentiment, label)`` of reviews with text and a clear rating."""
    labelled = reviews.dropna(subset=[text, "star_rating"]).select(
        key,
        F.col(text).alias("text"),
        weak_label(F.col("star_rating")).alias("sentiment"),
        weak_label_index(F.col("star_rating")).alias("label"),
    )
    return labelled.where(F.col("label").isNotNull())


def fit_tfidf(train: DataFrame, max_features: int = MAX_FEATURES) -> PipelineModel:
    """Tokens, counts, smoothed IDF plus one, unit length."""
    counts = Pipeline(
        stages=[
            RegexTokenizer(
                inputCol="text", outputCol="words", pattern=f"[{WORD}]+", gaps=False, minTokenLength=2
            ),
            CountVectorizer(inputCol="words", outputCol="tf", vocabSize=max_features),
        ]
    ).fit(train)
    idf = IDF(inputCol="tf", outputCol="unused").fit(counts.transform(train)).idf
    shifted = Vectors.dense(idf.toArray() + 1.0)
    return PipelineModel(
        [
            *counts.stages,
            ElementwiseProduct(scalingVec=shifted, inputCol="tf", outputCol="weighted"),
            Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
        ]
    )


def estimators(rows: int) -> Mapping[str, object]:
    """The compared classifiers; the penalty corresponds to C = 1 on ``rows`` training rows."""
    penalty = 1.0 / max(rows, 1)
    return {
        "Naive_Bayes": NaiveBayes(modelType="multinomial", smoothing=1.0),
        "Logistic_Regression": LogisticRegression(
            maxIter=1000, regParam=penalty, standardization=False, tol=1e-4
        ),
        "LinearSVC": LinearSVC(maxIter=1000, regParam=penalty, standardization=False, tol=1e-4),
    }


def fit_baselines(train: DataFrame, max_features: int = MAX_FEATURES) -> dict[str, PipelineModel]:
    """Fit every baseline on ``(text, label)``; each result scores raw text."""
    features = fit_tfidf(train, max_features)
    rows = train.count()
    data = features.transform(train).select("label", "features")
    # Every pass sends one gradient per partition: small data is better off in few.
    natural = data.rdd.getNumPartitions()
    wanted = min(
        max(natural, train.sparkSession.sparkContext.defaultParallelism), -(-rows // _ROWS_PER_PARTITION) or 1
    )
    if wanted != natural:
        data = data.repartition(wanted)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {
            name: PipelineModel([*features.stages, estimator.fit(data)])
            for name, estimator in estimators(rows).items()
        }
    finally:
        data.unpersist()


def predict(models: Mapping[str, PipelineModel], test: DataFrame) -> DataFrame:
    """``(model, label, prediction, is_positive, score)`` of all models on the test rows."""
    parts = []
    for name, model in models.items():
        scored = without_summaries(model).transform(test)
        column = "probability" if "probability" in scored.columns else "rawPrediction"
        parts.append(
            scored.select(
                F.lit(name).alias("model"),
                "label",
                "prediction",
                (F.col("label") == 1.0).alias("is_positive"),
                vector_to_array(F.col(column)).getItem(1).alias("score"),
            )
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def metrics_table(predictions: DataFrame) -> DataFrame:
    """``(model, accuracy, macro_f1, roc_auc)``."""
    scores = accuracy_and_macro_f1(predictions, by=["model"])
    return scores.join(roc_auc(predictions, by=["model"]), "model").select(
        "model", "accuracy", "macro_f1", "roc_auc"
    )


def compare_baselines(
    reviews: DataFrame,
    key: str = "review_id",
    text: str = "clean_text",
    test_share: float = 0.2,
    seed: int = 42,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """Split, fit all baselines on the training part and measure them on the test part.

    The training rows are written once: fitting passes over them many times.
    """
    rows = materialise(training_rows(reviews, key, text), "training")
    split = stratified_split(rows, "sentiment", key, test_share, seed)
    models = fit_baselines(split.where(~F.col("is_test")), max_features)
    # The measures read the predictions several times.
    return metrics_table(materialise(predict(models, split.where("is_test")), "predictions"))
