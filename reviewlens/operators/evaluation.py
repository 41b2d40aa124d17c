"""Classifier metrics as aggregates, for any number of models in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.rules import known
from reviewlens.sources.scratch import materialise

_SCORE_RANGES = 256


def confusion_matrix(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return predictions.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("count"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def class_scores(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1, support and hits of every class that occurs as label or prediction."""
    matrix = confusion_matrix(predictions, label, prediction, by)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(label).alias("class"), F.col("count").alias("support"), none.alias("predicted")),
        F.struct(F.col(prediction).alias("class"), none.alias("support"), F.col("count").alias("predicted")),
    )
    hit = F.when(F.col(label) == F.col(prediction), F.col("count")).otherwise(F.lit(0))
    # Each cell counts once for its label and once for its prediction; a hit is counted on the label side.
    cells = matrix.select(*by, hit.alias("_hit"), F.posexplode(sides).alias("_side", "_cell"))
    sums = cells.groupBy(*by, F.col("_cell.class").alias("class")).agg(
        F.sum(F.when(F.col("_side") == 0, F.col("_hit")).otherwise(0)).alias("_hits"),
        F.sum("_cell.support").alias("support"),
        F.sum("_cell.predicted").alias("_predicted"),
    )
    zero = F.lit(0.0)
    return sums.select(
        *by,
        "class",
        F.coalesce(F.try_divide("_hits", "_predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("_hits", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("_hits"), F.col("_predicted") + F.col("support")), zero).alias("f1"),
        "support",
        F.col("_hits").alias("hits"),
    )


def accuracy_and_macro_f1(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, accuracy, macro_f1)``; macro F1 is the plain mean over classes."""
    scores = class_scores(predictions, label, prediction, by)
    return scores.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def roc_auc(
    predictions: DataFrame, is_positive: str = "is_positive", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, roc_auc)``: exact area under the ROC curve, ties counting one half.

    Equal scores collapse first. Negatives below a score are the negatives of lower
    score ranges, from a table of range totals, plus those inside its range. Ranges
    lie between approximate quantiles of the collapsed scores, so each holds about
    as many, whatever the scale. Rows without a score take no part.
    """
    keys = list(by)
    positive = known(F.col(is_positive))
    points = (
        predictions.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("_score"))
        .agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    )
    # Read for the cuts, the totals and the ranks.
    points = materialise(points, "points")
    shares = F.array(*[F.lit(i / _SCORE_RANGES) for i in range(1, _SCORE_RANGES)])
    cuts = points.groupBy(*keys).agg(F.percentile_approx("_score", shares, F.lit(10_000)).alias("_cuts"))
    if keys:  # one row per model
        points = points.join(F.broadcast(cuts), keys)
    else:
        points = points.withColumn("_cuts", cuts.scalar())
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col("_score")))
    points = points.withColumn("_bucket", below).drop("_cuts")
    totals = points.groupBy(*keys, "_bucket").agg(F.sum("_neg").alias("_bucket_neg"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below_bucket = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_bucket_neg").over(lower), F.lit(0)).alias("_below")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    )
    area = points.join(below_bucket, [*keys, "_bucket"]).withColumn(
        "_lower", F.col("_below") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    )
    return area.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("_pos") * (F.col("_lower") + 0.5 * F.col("_neg"))),
            F.sum("_pos").cast("double") * F.sum("_neg"),
        ).alias("roc_auc")
    )
