"""Feature text with a lemma table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import STOP_WORDS
from reviewlens.functions.text import feature_text, feature_tokens
from reviewlens.operators.columns import with_computed
from reviewlens.sources.scratch import materialise


def clean_reviews(
    reviews: DataFrame,
    text: str = "review_text",
    stop_words: Sequence[str] = STOP_WORDS,
    min_tokens: int = 5,
) -> DataFrame:
    """Reviews with ``clean_text``, without those that have too few tokens left."""
    cleaned = with_computed(reviews, "clean_text", feature_text(F.col(text), stop_words, None, min_tokens))
    return cleaned.where(F.col("clean_text") != "")


def clean_reviews_with_lemmas(
    reviews: DataFrame,
    lemmas: DataFrame,
    key: str = "review_id",
    text: str = "review_text",
    stop_words: Sequence[str] = STOP_WORDS,
    min_tokens: int = 5,
    part_bytes: int = 32 << 20,
    most_broadcast: int = 32 << 20,
) -> DataFrame:
    """The same with each token replaced by its lemma from ``lemmas(token, lemma)``.

    ``key`` is unique; rows with a null key go. Of several lemmas of a token the least counts, a null one is none.
    No occurrence is shuffled by token. Up to ``most_broadcast`` bytes the lemmas go to every task. Beyond, texts are
    written as numbers into the vocabulary of their part, and lemmas are joined with the vocabularies: a token that
    stands in every text reaches that join once per part, however often it occurs.
    """
    changes = lemmas.where(F.col("lemma").isNotNull()).groupBy("token").agg(F.min("lemma").alias("lemma"))
    changes = materialise(changes.where("token <> lemma"), "lemmas")
    narrow = reviews.select(key, F.col(text).alias("_text")).where(F.col(key).isNotNull())
    weight = changes.agg(F.sum(F.octet_length("token") + F.octet_length("lemma") + 32)).first()[0] or 0
    if weight <= most_broadcast:
        tokens = _long_enough(narrow.repartition(key), stop_words, min_tokens)
        each = tokens.select(key, F.posexplode("_tokens").alias("_pos", "token"))
        named = each.join(F.broadcast(changes), "token", "left")
        entries = F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("lemma", "token").alias("word"))))
        cleaned = named.groupBy(key).agg(F.array_join(F.transform(entries, lambda e: e["word"]), " ").alias("clean_text"))
        return reviews.join(cleaned, key)
    size = narrow.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    placed = _long_enough(narrow, stop_words, min_tokens).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    texts, vocabulary = dictionary_encoded(materialise(placed, "tokens"), key, parts)
    # Each part's words stand in one array in the order of their numbers.
    words = F.transform("_ids", lambda i: F.get("_words", i - 1))
    cleaned = texts.join(vocabulary_lemmas(vocabulary, changes), "_part").select(key, F.array_join(words, " ").alias("clean_text"))
    return reviews.join(cleaned, key)


def _long_enough(texts: DataFrame, stop_words: Sequence[str], min_tokens: int) -> DataFrame:
    """``texts`` with ``_tokens`` in place of ``_text``, without those that have too few."""
    tokens = with_computed(texts, "_tokens", feature_tokens(F.col("_text"), stop_words))
    return tokens.where(F.size("_tokens") >= min_tokens).drop("_text")


def dictionary_encoded(tokens: DataFrame, key: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """``(_part, key, _ids)`` and ``(_part, token)`` of ``tokens(key, _tokens, _part)``.

    A number is the place of a token, from 1, among the distinct tokens of its part in code point order. Occurrences
    are shuffled by part only; a vocabulary is combined before its shuffle.
    """
    placed = tokens.select("_part", key, "_tokens").repartition(parts, "_part")
    each = placed.select("_part", key, F.posexplode("_tokens").alias("_pos", "token"))
    numbered = each.withColumn("_id", F.dense_rank().over(Window.partitionBy("_part").orderBy("token")))
    entries = F.sort_array(F.collect_list(F.struct("_pos", "_id")))
    texts = numbered.groupBy("_part", key).agg(F.transform(entries, lambda e: e["_id"]).alias("_ids"))
    vocabulary = tokens.select("_part", F.explode(F.array_distinct("_tokens")).alias("token")).distinct()
    return texts, vocabulary


def vocabulary_lemmas(vocabulary: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``(_part, _words)``: the words of each part after lemmas, one row per token, in the order of their numbers."""
    named = vocabulary.join(lemmas, "token", "left").select("_part", F.struct("token", F.coalesce("lemma", "token").alias("word")).alias("_entry"))
    arrays = named.groupBy("_part").agg(F.sort_array(F.collect_list("_entry")).alias("_entries"))
    return arrays.select("_part", F.transform("_entries", lambda e: e["word"]).alias("_words"))


def plural_lemmas(words: DataFrame, token: str = "token") -> DataFrame:
    """``(token, lemma)`` for words in -s, -es and -ies whose stem is itself among ``words``."""
    # Read twice; making it cleans every text.
    known = materialise(words.select(F.col(token).alias("token")).distinct(), "words")
    endings = [("^(.+)ies$", "y"), ("^(.+)es$", ""), ("^(.+[^s])s$", "")]
    stems = F.array(
        *[
            F.struct(
                F.lit(i).alias("order"),
                F.regexp_extract("token", pattern, 1).alias("stem"),
                F.lit(end).alias("end"),
            )
            for i, (pattern, end) in enumerate(endings)
        ]
    )
    proposed = (
        known.where(F.col("token").endswith("s"))
        .select("token", F.inline(stems))
        .where(F.col("stem") != "")
        .select("token", "order", F.concat("stem", "end").alias("lemma"))
    )
    valid = proposed.join(known.select(F.col("token").alias("lemma")), "lemma")
    return valid.groupBy("token").agg(F.min_by("lemma", "order").alias("lemma"))


def clean_and_count(
    reviews: DataFrame,
    text: str = "review_text",
    stop_words: Sequence[str] = STOP_WORDS,
    min_tokens: int = 5,
) -> tuple[DataFrame, dict[str, int]]:
    """Cleaned reviews, written once, with the numbers of rows before and after the length rule and their difference.

    The numbers are observed while the rows are written; nothing is read twice.
    """
    before, after = Observation("before"), Observation("after")
    seen = reviews.observe(before, F.count(F.lit(1)).alias("rows"))
    kept = clean_reviews(seen, text, stop_words, min_tokens).observe(after, F.count(F.lit(1)).alias("rows"))
    cleaned = materialise(kept, "cleaned")
    rows = [o.get.get("rows", 0) for o in (before, after)]
    return cleaned, {"before": rows[0], "after": rows[1], "filtered_out": rows[0] - rows[1]}


def filtered_out(reviews: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: reviews before and after the length rule and the difference."""
    before = reviews.agg(F.count(F.lit(1)).alias("before"))
    after = cleaned.agg(F.count(F.lit(1)).alias("after"))
    return before.withColumn("after", after.scalar()).withColumn(
        "filtered_out", F.col("before") - F.col("after")
    )
