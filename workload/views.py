"""The driver tables seen as reviews.

``documents`` plays the review table, ``labels`` the partly scored sentiment table.
The texts hold no product words, so ``aspect_text`` puts a short sentence in front.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.rules import is_mismatch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as seq",
        "cast(doc_id as string) as review_id",
        "source as app_name",
        "text as review_text",
        "cast(1 + (doc_id * 7 + n_chars) % 5 as double) as star_rating",
        "date_add(date '2024-01-01', cast(doc_id * 13 % 90 as int)) as review_date",
        "n_chars % 40 as thumbs_up",
    )


def worded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose text starts with a sentence about the product."""
    return reviews(spark, sf_dir).withColumn(
        "review_text",
        F.expr(
            """case seq % 8 when 0 then 'keeps crashing after the update'
                            when 1 then 'the price and subscription cost too much'
                            when 2 then 'great matches only'
                            when 3 then 'fake profile and bot'
                            when 4 then 'user friendly design with dark mode'
                            when 5 then 'my date was a match'
                            when 6 then 'nothing special' else '' end || ' ' || review_text"""
        ),
    )


def sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(review_id, sentiment_label, sentiment_score)`` of the scored part."""
    return table(spark, sf_dir, "labels").selectExpr(
        "cast(doc_id as string) as review_id",
        "case quality when 1 then 'Positive' when 0 then 'Negative' end as sentiment_label",
        "0.5e0 + (doc_id % 50) / 100e0 as sentiment_score",
    )


def scored(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``df`` that have a sentiment."""
    return df.join(sentiments(spark, sf_dir), "review_id")


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(reviews(spark, sf_dir), spark, sf_dir)
    return rows.withColumn("is_mismatch", is_mismatch(F.col("star_rating"), F.col("sentiment_label")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of three tables: prose, web pages, short messages."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("'d' || doc_id as id", "text")
        .union(table(spark, sf_dir, "pages").selectExpr("'p' || page_id as id", "html"))
        .union(table(spark, sf_dir, "conversations").selectExpr("'c' || conv_id || '-' || turn as id", "text"))
    )


# Marks with their names; some are parts of others.
EMOJI = {
    "\u2764": "heart",
    "\u2764\ufe0f": "red_heart",
    "\U0001f469": "woman",
    "\U0001f4bb": "laptop",
    "\U0001f469\u200d\U0001f4bb": "woman_technologist",
    "\U0001f44d": "thumbs_up",
    "\U0001f44d\U0001f3fd": "thumbs_up_medium_skin_tone",
    "1\ufe0f\u20e3": "keycap_1",
}


def texts_with_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts; most start with two marks, alone, joined or with a skin tone."""
    marks = [*EMOJI, "\U0001f4bb\u200d\u2764", "\U0001f44d\U0001f3fd\U0001f44d", "\u2603", ""]
    listed = ", ".join(f"'{m}'" for m in marks)
    pick = f"element_at(array({listed}), cast(1 + (length(text) + {{}}) % {len(marks)} as int))"
    return texts(spark, sf_dir).selectExpr("id", f"{pick.format(0)} || {pick.format(5)} || ' ' || text as text")


def emoji_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EMOJI.items()), "mark string, name string")


def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a user's file might present them: odd headers, bad numbers, mixed dates."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn as line",
        "text as `Content [message text]`",
        "case when turn % 3 = 0 then cast(conv_id % 5 + 1 as string) when turn % 3 = 1 then 'n/a' end as `Rating`",
        """case turn % 3 when 0 then date_format(date_add(date '2025-01-01', cast(conv_id % 300 as int)), 'dd/MM/yyyy')
                         when 1 then date_format(date_add(date '2025-01-01', cast(conv_id % 300 as int)), 'yyyy-MM-dd')
                         else 'unknown' end as `Created_At [day first]`""",
        "role",
    )


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as CSV records, some of them damaged; the bytes may not be UTF-8."""
    return table(spark, sf_dir, "conversations").selectExpr(
        """cast(concat(cast(conv_id * 1000 + turn as string), ',', case (conv_id + turn) % 5
               when 0 then '"' || replace(text, '"', '""') || '"'
               when 1 then '"' || replace(text, '"', '""') || '",' || role || ',more'
               when 2 then concat(cast('"' as binary), X'FF', cast('",' || role as binary))
               when 3 then '"\uFFFD ' || replace(text, '"', '""') || '",' || role
               else '"' || replace(text, '"', '""') || '\r\n",' || role end) as string) as value"""
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release days: per event type the day of its largest value."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.max_by(F.to_date("ts"), "value").alias("released")
    ).select("released", F.col("event_type").alias("version"))
