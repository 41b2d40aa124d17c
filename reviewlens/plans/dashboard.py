"""Dashboard queries over the analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.rules import keep_short_opinions, known
from reviewlens.functions.values import iso_day, page_count, percentage, whole_percentage
from reviewlens.operators.keys import first_per_key
from reviewlens.schemas import NEGATIVE, POSITIVE

# Filters behind the preset buttons of the review explorer.
PRESETS = {
    "all": {},
    "mismatch": {"is_mismatch": True},
    "spam": {"is_spam": True},
    "positive": {"sentiment": POSITIVE},
    "negative": {"sentiment": NEGATIVE},
}

MAX_PAGE_SIZE = 100


def _one_per_review(df: DataFrame, order: str | None) -> DataFrame:
    """First row per review; without an order column any row, which is right when they agree."""
    others = [c for c in df.columns if c != "review_id"]
    return first_per_key(df, ["review_id"], F.col(order) if order else F.struct(*others))


def _positive() -> Column:
    return F.count_if(F.col("sentiment") == POSITIVE)


def _negative() -> Column:
    return F.count_if(F.col("sentiment") == NEGATIVE)


def enriched_reviews(
    raw: DataFrame, mismatches: DataFrame, flagged: DataFrame, keep_opinions: bool = True, order: str | None = None
) -> DataFrame:
    """Reviews with sentiment and both flags; every raw row appears once.

    Of several results for a review the first by ``order`` counts, a column of both result tables.
    """
    first = [order] if order else []
    scores = mismatches.select("review_id", "sentiment_label", "sentiment_score", "is_mismatch", *first)
    sentiment = _one_per_review(scores, order).drop(*first)
    spam = _one_per_review(flagged.select("review_id", "is_spam", *first), order).drop(*first)
    joined = raw.join(sentiment, "review_id", "left").join(spam, "review_id", "left")
    spam_flag = (
        keep_short_opinions(F.col("is_spam"), F.col("review_text"), F.col("star_rating"))
        if keep_opinions
        else known(F.col("is_spam"))
    )
    return joined.withColumns({"is_mismatch": known(F.col("is_mismatch")), "is_spam": spam_flag})


def summary(
    raw: DataFrame,
    aspects: DataFrame,
    flagged: DataFrame,
    mismatches: DataFrame,
    aspect_order: str | None = None,
) -> DataFrame:
    """One row of key figures. ``spam_count_raw`` counts flags before short opinions are cleared."""
    wanted = ["review_id", "sentiment"] + ([aspect_order] if aspect_order else [])
    per_review = _one_per_review(aspects.select(*wanted), aspect_order)
    counts = per_review.agg(F.struct(_positive().alias("pos"), _negative().alias("neg")).alias("s"))
    positive, negative = F.col("_s.pos"), F.col("_s.neg")
    scored = positive + negative
    return (
        raw.agg(
            F.count(F.lit(1)).alias("total_reviews"),
            F.bround(F.avg("star_rating"), 2).alias("avg_rating"),
        )
        .withColumns(
            {
                "_s": counts.scalar(),
                "spam_count_raw": flagged.agg(F.count_if("is_spam")).scalar(),
                "mismatch_count": mismatches.agg(F.count_if("is_mismatch")).scalar(),
            }
        )
        .select(
            "total_reviews",
            "avg_rating",
            percentage(positive, scored).alias("positive_pct"),
            percentage(negative, scored).alias("negative_pct"),
            "spam_count_raw",
            "mismatch_count",
            whole_percentage(positive, scored).alias("positive_share"),
            ((F.col("spam_count_raw") > 0) | (F.col("mismatch_count") > 0)).alias("has_anomalies"),
        )
    )


def daily_trends(enriched: DataFrame) -> DataFrame:
    """Positive and negative reviews per day, oldest first."""
    dated = enriched.dropna(subset=["review_date", "sentiment_label"]).withColumn(
        "date", iso_day(F.col("review_date"))
    )
    return (
        dated.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(
            F.count_if(F.col("sentiment_label") == POSITIVE).alias("positive"),
            F.count_if(F.col("sentiment_label") == NEGATIVE).alias("negative"),
        )
        .orderBy("date")
    )


def mismatch_list(mismatches: DataFrame) -> DataFrame:
    """Mismatched reviews with the columns a client shows."""
    return mismatches.where(F.col("is_mismatch")).select(
        F.col("review_id").cast("string"),
        "review_text",
        F.col("star_rating").cast("double"),
        "sentiment_label",
        F.col("sentiment_score").cast("double"),
    )


def matching_reviews(
    enriched: DataFrame,
    sentiment: str | None = None,
    min_stars: float | None = None,
    max_stars: float | None = None,
    is_mismatch: bool | None = None,
    is_spam: bool | None = None,
) -> DataFrame:
    """Reviews that satisfy every given filter."""
    conditions = []
    if sentiment:
        conditions.append(F.col("sentiment_label") == sentiment)
    if min_stars is not None:
        conditions.append(F.col("star_rating") >= min_stars)
    if max_stars is not None:
        conditions.append(F.col("star_rating") <= max_stars)
    if is_mismatch is not None:
        conditions.append(F.col("is_mismatch") == is_mismatch)
    if is_spam is not None:
        conditions.append(F.col("is_spam") == is_spam)
    for condition in conditions:
        enriched = enriched.where(condition)
    return enriched


def review_items(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        F.col("review_id").cast("string").alias("review_id"),
        F.coalesce(F.col("app_name").cast("string"), F.lit("")).alias("app_name"),
        F.coalesce(F.col("review_text").cast("string"), F.lit("")).alias("review_text"),
        F.col("star_rating").cast("double").alias("star_rating"),
        F.col("review_date").cast("string").alias("review_date"),
        "sentiment_label",
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "is_mismatch",
        "is_spam",
        (F.col("is_mismatch") | F.col("is_spam")).alias("is_anomaly"),
    )


def _check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1, page_size is 1 to {MAX_PAGE_SIZE}")


def reviews_total(matching: DataFrame, page_size: int = 20) -> DataFrame:
    """One row: number of matching reviews and of pages."""
    return matching.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", page_count(F.col("total"), page_size)
    )


def reviews_page(matching: DataFrame, order: str, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page in the given unique order, with the total of all matching reviews.

    Cost grows with the offset; ``reviews_after`` does not have that problem.
    """
    _check_page(page, page_size)
    rows = matching.orderBy(order).offset((page - 1) * page_size).limit(page_size)
    total = matching.agg(F.count(F.lit(1)).alias("n")).scalar()
    return review_items(rows).withColumn("total", total)


def reviews_after(matching: DataFrame, order: str, last_seen: object | None, page_size: int = 20) -> DataFrame:
    """The page that follows the order value of the last row seen.

    Where the page ends is found first, from the columns that the filters read; texts beyond it are not moved.
    """
    _check_page(1, page_size)
    at = F.col(order)
    rows = matching if last_seen is None else matching.where(at > F.lit(last_seen))
    end = rows.select(at.alias("_at")).orderBy("_at").limit(page_size).agg(F.max("_at")).scalar()
    return rows.where(at.isNull() | (at <= end)).orderBy(order).limit(page_size)


def compare_apps(raw: DataFrame, aspects: DataFrame, aspect_order: str | None = None) -> DataFrame:
    """Reviews, mean rating and sentiment shares per app, by name."""
    wanted = ["review_id", "app_name", "sentiment"] + ([aspect_order] if aspect_order else [])
    ratings = (
        raw.where(F.col("app_name").isNotNull())
        .groupBy("app_name")
        .agg(
            F.count(F.lit(1)).alias("total_reviews"),
            F.bround(F.avg("star_rating"), 2).alias("avg_rating"),
        )
    )
    sentiment = (
        _one_per_review(aspects.select(*wanted), aspect_order)
        .groupBy("app_name")
        .agg(_positive().alias("_pos"), _negative().alias("_neg"))
    )
    scored = F.col("_pos") + F.col("_neg")
    return (
        ratings.join(sentiment, "app_name", "left")
        .select(
            "app_name",
            "total_reviews",
            "avg_rating",
            percentage(F.col("_pos"), scored).alias("positive_pct"),
            percentage(F.col("_neg"), scored).alias("negative_pct"),
        )
        .orderBy("app_name")
    )


def app_names(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("app_name").isNotNull()).select("app_name").distinct().orderBy("app_name")
