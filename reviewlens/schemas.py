"""Table schemas and the column names accepted on ingest."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


RAW_REVIEWS = _struct(
    ("review_id", StringType()),
    ("app_name", StringType()),
    ("review_text", StringType()),
    ("star_rating", DoubleType()),
    ("review_date", DateType()),
    ("thumbs_up", LongType()),
)

CLEAN_REVIEWS = _struct(*[(f.name, f.dataType) for f in RAW_REVIEWS], ("clean_text", StringType()))

ASPECT_RESULTS = _struct(
    ("review_id", StringType()),
    ("app_name", StringType()),
    ("review_text", StringType()),
    ("clean_text", StringType()),
    ("star_rating", DoubleType()),
    ("aspect", StringType()),
    ("sentiment", StringType()),
    ("confidence", DoubleType()),
)

MISMATCHES = _struct(
    ("review_id", StringType()),
    ("app_name", StringType()),
    ("review_text", StringType()),
    ("star_rating", DoubleType()),
    ("sentiment_label", StringType()),
    ("sentiment_score", DoubleType()),
    ("is_mismatch", BooleanType()),
)

FLAGGED_REVIEWS = _struct(
    ("review_id", StringType()),
    ("app_name", StringType()),
    ("review_text", StringType()),
    ("star_rating", DoubleType()),
    ("flag_reason", StringType()),
    ("is_spam", BooleanType()),
)

KEYWORD = _struct(("word", StringType()), ("tfidf", DoubleType()), ("count", LongType()))

KEYWORD_LISTS = _struct(
    ("positive", ArrayType(KEYWORD)),
    ("negative", ArrayType(KEYWORD)),
    ("top", ArrayType(KEYWORD)),
)

METRICS = _struct(
    ("model", StringType()),
    ("accuracy", DoubleType()),
    ("macro_f1", DoubleType()),
    ("roc_auc", DoubleType()),
)

TABLES = {
    "raw_reviews": RAW_REVIEWS,
    "clean_reviews": CLEAN_REVIEWS,
    "aspect_results": ASPECT_RESULTS,
    "mismatches": MISMATCHES,
    "flagged_reviews": FLAGGED_REVIEWS,
    "keywords": KEYWORD_LISTS,
    "metrics": METRICS,
}

# Header names accepted for an uploaded file.
TEXT_NAMES = ("review_text", "text", "content", "review")
RATING_NAMES = ("star_rating", "rating", "score")
APP_NAMES = ("app_name", "app", "source")
DATE_NAMES = ("review_date", "date", "created_at", "at")

# Field names of a store export and what they become.
STORE_FIELDS = {
    "reviewId": "review_id",
    "content": "review_text",
    "score": "star_rating",
    "at": "review_date",
    "thumbsUpCount": "thumbs_up",
}

POSITIVE = "Positive"
NEGATIVE = "Negative"
