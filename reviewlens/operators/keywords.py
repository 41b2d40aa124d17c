"""Keyword lists per sentiment class, by frequency and by mean TF-IDF.

The classes are "positive", "negative" and "top" (all labelled texts). All three
come out of one pass: counts are taken per sentiment and rolled up to classes when
they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import STOP_WORDS
from reviewlens.functions.rules import is_blank
from reviewlens.functions.text import keyword_tokens, without_words, word_tokens
from reviewlens.operators.keys import first_per_key
from reviewlens.operators.tfidf import smoothed_idf, term_counts, term_totals, vocabulary_per_group
from reviewlens.schemas import NEGATIVE, POSITIVE
from reviewlens.sources.scratch import materialise

TOP_N = 50
MAX_FEATURES = 5_000


def distinct_texts(
    labelled: DataFrame, text: str = "clean_text", sentiment: str = "sentiment", order: str = "seq"
) -> DataFrame:
    """Labelled rows, one per distinct text; the first row gives key and sentiment."""
    return first_per_key(labelled.dropna(subset=[text, sentiment]), [text], order)


def own_class(sentiment: Column) -> Column:
    return F.when(sentiment == POSITIVE, F.lit("positive")).when(sentiment == NEGATIVE, F.lit("negative"))


def roll_up(per_sentiment: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add up rows of ``own`` classes, once under their own class and once under "top"."""
    classes = F.explode(F.array_compact(F.array(F.col("own"), F.lit("top"))))
    return (
        per_sentiment.withColumn("class", classes)
        .groupBy("class", *keys)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def top_per_class(df: DataFrame, score: Column, n: int) -> DataFrame:
    order = Window.partitionBy("class").orderBy(score.desc(), F.asc("word"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def word_frequencies(
    texts: DataFrame,
    text: str = "clean_text",
    sentiment: str = "sentiment",
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``(class, word, count)`` for every word."""
    words = texts.select(
        own_class(F.col(sentiment)).alias("own"),
        F.explode(keyword_tokens(F.col(text), stop_words)).alias("word"),
    )
    return roll_up(words.groupBy("own", "word").agg(F.count(F.lit(1)).alias("count")), ["word"], ["count"])


def keyword_frequencies(
    texts: DataFrame,
    text: str = "clean_text",
    sentiment: str = "sentiment",
    n: int = TOP_N,
    stop_words: Sequence[str] = STOP_WORDS,
    min_count: int = 1,
) -> DataFrame:
    """``(class, rank, word, count)``: the ``n`` most frequent words of each class."""
    counts = word_frequencies(texts, text, sentiment, stop_words).where(F.col("count") >= min_count)
    return top_per_class(counts, F.col("count"), n).select("class", "rank", "word", "count")


def keyword_tfidf(
    texts: DataFrame,
    key: str = "review_id",
    text: str = "clean_text",
    sentiment: str = "sentiment",
    n: int = TOP_N,
    max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """``(class, rank, word, tfidf)``: the ``n`` words of each class with the largest mean TF-IDF.

    Vocabulary, IDF and document length are those of the class. The mean is over all
    texts of the class that are not blank. ``key`` is unique per text.
    """
    # Read three times below: for the class sizes, for the vocabulary and for the weights.
    texts = materialise(
        texts.where(~is_blank(F.col(text))).select(
            key, own_class(F.col(sentiment)).alias("own"), F.col(text).alias("_text")
        ),
        "texts",
    )
    counts = term_counts(texts, key, without_words(word_tokens(F.col("_text")), stop_words), "own")
    sizes = roll_up(texts.groupBy("own").agg(F.count(F.lit(1)).alias("documents")), [], ["documents"])
    totals = roll_up(term_totals(counts, "own"), ["term"], ["total", "df"])
    # At most 3 * max_features rows: written once, then broadcast.
    idf = materialise(
        vocabulary_per_group(totals, max_features, "class")
        .join(sizes, "class")
        .withColumn("idf", smoothed_idf(F.col("df"), F.col("documents"))),
        "idf",
    )
    own_idf = idf.where(F.col("class") != "top").select(
        F.col("class").alias("own"), "term", F.col("idf").alias("own_idf")
    )
    top_idf = idf.where(F.col("class") == "top").select("term", F.col("idf").alias("top_idf"))
    weighted = (
        counts.join(F.broadcast(own_idf), ["own", "term"], "left")
        .join(F.broadcast(top_idf), "term", "left")
        .where(F.col("own_idf").isNotNull() | F.col("top_idf").isNotNull())
    )
    entry = F.struct("term", F.col("tf") * F.col("own_idf"), F.col("tf") * F.col("top_idf"))
    documents = weighted.groupBy(key, "own").agg(
        F.collect_list(entry.cast("struct<term:string,own:double,top:double>")).alias("entries"),
        F.sqrt(F.sum(F.pow(F.col("tf") * F.col("own_idf"), 2))).alias("own_norm"),
        F.sqrt(F.sum(F.pow(F.col("tf") * F.col("top_idf"), 2))).alias("top_norm"),
    )
    sums = (
        documents.select("own", "own_norm", "top_norm", F.explode("entries").alias("e"))
        .groupBy("own", F.col("e.term").alias("word"))
        .agg(
            F.sum(F.try_divide(F.col("e.own"), F.col("own_norm"))).alias("own_sum"),
            F.sum(F.try_divide(F.col("e.top"), F.col("top_norm"))).alias("top_sum"),
        )
    )
    per_class = F.array(
        F.struct(F.col("own").alias("class"), F.col("own_sum").alias("weight")),
        F.struct(F.lit("top").alias("class"), F.col("top_sum").alias("weight")),
    )
    means = (
        sums.select("word", F.inline(per_class))
        .where(F.col("class").isNotNull() & F.col("weight").isNotNull())
        .groupBy("class", "word")
        .agg(F.sum("weight").alias("weight"))
        .join(F.broadcast(idf.select("class", "documents").distinct()), "class")
        .withColumn("mean", F.col("weight") / F.col("documents"))
    )
    # Twelve digits keep float noise out of the order of equal means.
    return top_per_class(means, F.bround("mean", 12), n).select(
        "class", "rank", "word", F.bround("mean", 6).alias("tfidf")
    )


def merge_keywords(tfidf: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(class, rank, word, tfidf, count)``; the count is 0 for a word without a frequency row.

    With ``keyword_frequencies`` a word outside the frequency list counts 0; pass
    ``word_frequencies`` for its true count.
    """
    counts = frequencies.select("class", "word", "count")
    return tfidf.join(counts, ["class", "word"], "left").select(
        "class", "rank", "word", "tfidf", F.coalesce("count", F.lit(0)).alias("count")
    )


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """The lists as one nested row; at most ``n`` words per class."""
    zero = F.lit(0.0)
    score = F.col("tfidf") if "tfidf" in keywords.columns else zero
    entry = F.struct("rank", "word", score.alias("tfidf"), "count")

    def words_of(name: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(F.col("class") == name, entry)))
        return F.transform(ordered, lambda e: F.struct(e["word"], e["tfidf"], e["count"])).cast(
            "array<struct<word:string,tfidf:double,count:bigint>>"
        )

    return keywords.agg(*[words_of(name).alias(name) for name in ("positive", "negative", "top")])


def keyword_rows(lists: DataFrame) -> DataFrame:
    """The nested row as ``(class, rank, word, tfidf, count)``."""
    parts = [
        lists.select(F.lit(name).alias("class"), F.posexplode(name).alias("pos", "e")).select(
            "class", (F.col("pos") + 1).alias("rank"), "e.word", "e.tfidf", "e.count"
        )
        for name in ("positive", "negative", "top")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
