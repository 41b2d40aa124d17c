"""The analysis jobs: from raw reviews to the tables the dashboard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import clean_for_model, squeezed_word_count
from reviewlens.operators.anomalies import flag_mismatches, flag_spam
from reviewlens.operators.aspects import aspect_rows, overall_aspect_rows
from reviewlens.operators.columns import with_computed
from reviewlens.operators.keys import first_rows
from reviewlens.operators.keywords import (
    distinct_texts,
    keyword_frequencies,
    keyword_lists,
    keyword_tfidf,
    merge_keywords,
)
from reviewlens.operators.scoring import Scorer
from reviewlens.operators.similarity import near_duplicate_ids
from reviewlens.schemas import FLAGGED_REVIEWS, MISMATCHES
from reviewlens.sources.ingest import existing_columns

MIN_WORDS = 4


def scorable_reviews(
    reviews: DataFrame,
    required: tuple[str, ...] = ("review_text",),
    max_rows: int | None = None,
    order: str = "seq",
) -> DataFrame:
    """Reviews with ``clean_text`` of at least four words; all of them unless ``max_rows`` is given."""
    present = reviews.dropna(subset=list(required))
    cleaned = with_computed(present, "clean_text", clean_for_model(F.col("review_text")))
    enough = squeezed_word_count(F.col("clean_text")) >= MIN_WORDS
    return first_rows(cleaned.where(enough), order, max_rows)


def spam_report(reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """All reviews with text and their spam flags."""
    reviews = reviews.where(F.col("review_text").isNotNull())
    return flag_spam(reviews, near_duplicate_ids(reviews, key))


def scored_reviews(reviews: DataFrame, scorer: Scorer) -> DataFrame:
    """All reviews with text, cleaned and scored: written once, it serves every report below."""
    present = reviews.dropna(subset=["review_text"])
    return scorer(with_computed(present, "clean_text", clean_for_model(F.col("review_text"))))


def _long_enough(scored: DataFrame) -> DataFrame:
    return scored.where(squeezed_word_count(F.col("clean_text")) >= MIN_WORDS)


def mismatches_of(scored: DataFrame) -> DataFrame:
    """The rows of :func:`scored_reviews` with four words and stars, and their mismatch flags."""
    return flag_mismatches(_long_enough(scored).dropna(subset=["star_rating"]))


def aspects_of_scored(scored: DataFrame) -> DataFrame:
    """The rows of :func:`scored_reviews` with four words, one per aspect."""
    return aspect_rows(_long_enough(scored))


def mismatch_report(reviews: DataFrame, scorer: Scorer) -> DataFrame:
    """All scorable reviews with label, score and mismatch flag."""
    scored = scorer(scorable_reviews(reviews, ("review_text", "star_rating")))
    return flag_mismatches(scored)


def aspect_report(reviews: DataFrame, scorer: Scorer) -> DataFrame:
    """All scorable reviews, one row per aspect."""
    return aspect_rows(scorer(scorable_reviews(reviews)))


def spam_table(report: DataFrame) -> DataFrame:
    return existing_columns(report, FLAGGED_REVIEWS)


def mismatch_table(report: DataFrame) -> DataFrame:
    return existing_columns(report, MISMATCHES)


def keyword_report(
    labelled: DataFrame, key: str = "review_id", order: str = "seq", n: int = 50
) -> DataFrame:
    """Merged keyword lists ``(class, rank, word, tfidf, count)`` of labelled texts."""
    texts = distinct_texts(labelled, order=order)
    return merge_keywords(keyword_tfidf(texts, key, n=n), keyword_frequencies(texts, n=n))


def upload_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """The served tables of a scored upload; flagged tables keep all rows with their flags."""
    frequencies = keyword_frequencies(scored, text="review_text", sentiment="sentiment_label")
    return {
        "raw_reviews": scored,
        "mismatches": scored,
        "flagged_reviews": scored.withColumn(
            "flag_reason", F.when(F.col("is_spam"), F.lit("too_short")).otherwise(F.lit(""))
        ),
        "aspect_results": overall_aspect_rows(scored),
        "keywords": keyword_lists(frequencies),
    }
