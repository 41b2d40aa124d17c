"""Sentiment scorers: functions from a DataFrame to the same rows with
``sentiment_label``, ``sentiment_score`` and ``sentiment_scores``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import SENTIMENT_WEIGHTS
from reviewlens.functions.text import bound, clean_for_model, word_tokens
from reviewlens.functions.values import confidence_of, label_of, score_map, softmax_positive
from reviewlens.operators.columns import with_computed

Scorer = Callable[[DataFrame], DataFrame]


def _with_scores(df: DataFrame, positive_probability: Column) -> DataFrame:
    p = F.col("_p")
    return (
        with_computed(df, "_p", positive_probability)
        .withColumns(
            {
                "sentiment_label": label_of(p),
                "sentiment_score": confidence_of(p),
                "sentiment_scores": score_map(p),
            }
        )
        .drop("_p")
    )


def lexicon_probability(words: Column, weights: Mapping[str, float] = SENTIMENT_WEIGHTS) -> Column:
    """Probability of Positive from word weights: positive and negative sums are the two logits."""
    by_weight: dict[float, list[str]] = defaultdict(list)
    for word, weight in weights.items():
        by_weight[weight].append(word)

    def probability(known: Column) -> Column:
        def hits(listed: list[str]) -> Column:
            return F.size(F.filter(known, lambda t: t.isin(listed)))

        def total(sign: int) -> Column:
            parts = [
                F.lit(abs(weight)) * hits(listed)
                for weight, listed in sorted(by_weight.items())
                if weight * sign > 0
            ]
            return sum(parts, F.lit(0.0))

        return softmax_positive(total(-1), total(1))

    everything = list(weights)
    return bound(F.filter(words, lambda t: t.isin(everything)), probability)


def lexicon_scorer(
    text: str = "review_text", weights: Mapping[str, float] = SENTIMENT_WEIGHTS
) -> Scorer:
    """Rule-based scorer; native expressions, no shuffle."""

    def score(df: DataFrame) -> DataFrame:
        words = word_tokens(clean_for_model(F.col(text)))
        return _with_scores(df, lexicon_probability(words, weights))

    return score


def without_summaries(model: PipelineModel) -> PipelineModel:
    """The model, whose stages forget the figures of their training: these hold the session, which tasks cannot
    be sent once it has observed rows.
    """
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def pipeline_scorer(model: PipelineModel, positive_index: int = 1) -> Scorer:
    """Scorer from a fitted pipeline with a ``probability`` column."""

    def score(df: DataFrame) -> DataFrame:
        scored = without_summaries(model).transform(df)
        added = [c for c in scored.columns if c not in df.columns]
        probability = vector_to_array(F.col("probability")).getItem(positive_index)
        return _with_scores(scored, probability).drop(*added)

    return score


def joined_scorer(scores: DataFrame, key: str = "review_id") -> Scorer:
    """Scorer that takes ready-made scores (label and score, one row per key) from a table."""

    def score(df: DataFrame) -> DataFrame:
        return df.join(scores.select(key, "sentiment_label", "sentiment_score"), key, "left")

    return score


def predictor_scorer(
    load_predictor: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "review_text",
    batch_size: int = 200,
) -> Scorer:
    """Scorer around an external model.

    ``load_predictor`` runs once per Python worker task and returns a function from
    cleaned texts to logits of shape (n, 2), Negative first.
    """

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load_predictor()
        for batch in batches:
            parts = [
                np.asarray(predict(batch.iloc[i : i + batch_size].tolist()), dtype="float64")
                for i in range(0, len(batch), batch_size)
            ]
            yield pd.Series([row for part in parts for row in part], index=batch.index, dtype="object")

    def score(df: DataFrame) -> DataFrame:
        scored = df.withColumn("_logits", logits(clean_for_model(F.col(text))))
        probability = softmax_positive(F.col("_logits")[0], F.col("_logits")[1])
        return _with_scores(scored, probability).drop("_logits")

    return score


def onnx_scorer(
    model_file: str,
    encode: Callable[[list[str]], dict[str, np.ndarray]],
    text: str = "review_text",
) -> Scorer:
    """Scorer for an ONNX classifier shipped with ``SparkContext.addFile``.

    ``encode`` turns texts into the model's input arrays.
    """

    def load():
        import onnxruntime
        from pyspark import SparkFiles

        session = onnxruntime.InferenceSession(SparkFiles.get(model_file))
        wanted = {i.name for i in session.get_inputs()}

        def predict(texts: list[str]) -> np.ndarray:
            feeds = {k: v for k, v in encode(texts).items() if k in wanted}
            return session.run(None, feeds)[0]

        return predict

    return predictor_scorer(load, text)
