"""Spam and mismatch reports over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.rules import flag_reason, is_mismatch, is_repetitive, is_too_short
from reviewlens.functions.values import percentage


def flag_spam(
    reviews: DataFrame, duplicate_ids: DataFrame | None, text: str = "review_text"
) -> DataFrame:
    """Add ``is_short``, ``is_repetitive``, ``is_duplicate``, ``is_spam`` and ``flag_reason``.

    ``duplicate_ids`` holds the ``review_id`` of every near-duplicate once; without it
    only the two rules on the text itself apply.
    """
    # The rules on the text come before the join, which then moves it only where it is asked for.
    reviews = reviews.withColumns({"is_short": is_too_short(F.col(text)), "is_repetitive": is_repetitive(F.col(text))})
    if duplicate_ids is None:
        marked = reviews.withColumn("_dup", F.lit(False))
    else:
        marked = reviews.join(
            duplicate_ids.select("review_id", F.lit(True).alias("_dup")), "review_id", "left"
        )
    short, repetitive, duplicate = F.col("is_short"), F.col("is_repetitive"), F.col("is_duplicate")
    return (
        marked.withColumn("is_duplicate", F.coalesce(F.col("_dup"), F.lit(False)))
        .withColumns(
            {
                "is_spam": short | repetitive | duplicate,
                "flag_reason": flag_reason(short, repetitive, duplicate),
            }
        )
        .drop("_dup")
    )


def spam_breakdown(flagged: DataFrame) -> DataFrame:
    """One row: reviews, flagged reviews with their share, and hits per rule."""
    total = F.col("total")
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_spam").alias("spam"),
        F.count_if("is_short").alias("too_short"),
        F.count_if("is_repetitive").alias("repetitive"),
        F.count_if("is_duplicate").alias("near_duplicate"),
    ).withColumn("spam_pct", percentage(F.col("spam"), total))


def flag_mismatches(scored: DataFrame) -> DataFrame:
    return scored.withColumn("is_mismatch", is_mismatch(F.col("star_rating"), F.col("sentiment_label")))


def mismatch_breakdown(flagged: DataFrame) -> DataFrame:
    """One row: reviews, mismatches by direction and their share."""
    flag, stars = F.col("is_mismatch"), F.col("star_rating")
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(flag).alias("mismatches"),
        F.count_if(flag & (stars >= 4)).alias("high_rating_negative"),
        F.count_if(flag & (stars <= 2)).alias("low_rating_positive"),
    ).withColumn("mismatch_pct", percentage(F.col("mismatches"), F.col("total")))
