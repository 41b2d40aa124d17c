"""Keyword counts kept up to date by signed changes: only new and replaced texts are tokenised.

The state is two tables, each a list of folders that a manifest names (:mod:`reviewlens.sources.datasets`):

- ``terms``: one row per text and update with its words and their counts; the latest update of a key holds,
- ``changes``: per update, class and word what was added to and taken from counts and document numbers; the row
  without a word counts the texts.

Sums of ``changes`` are the state. They may be added in any order and merged at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import STOP_WORDS
from reviewlens.functions.text import keyword_tokens
from reviewlens.operators.columns import with_computed
from reviewlens.operators.keywords import TOP_N, own_class, roll_up, top_per_class
from reviewlens.sources.datasets import commit, dataset
from reviewlens.sources.scratch import materialise


def _counted(rows: DataFrame, text: str, sentiment: str, stop_words: Sequence[str]) -> DataFrame:
    """``(review_id, own, words)``: words of a text with their counts."""
    texts = rows.select("review_id", own_class(F.col(sentiment)).alias("own"), F.col(text).alias("_text"))
    worded = with_computed(texts, "_words", F.coalesce(keyword_tokens(F.col("_text"), stop_words), F.array()))
    each = worded.select("review_id", "own", F.explode_outer("_words").alias("word"))
    counts = each.groupBy("review_id", "own", "word").agg(F.count("word").alias("tf"))
    entry = F.when(F.col("word").isNotNull(), F.struct("word", "tf"))
    return counts.groupBy("review_id", "own").agg(F.collect_list(entry).alias("words"))


def _signed(texts: DataFrame, sign: int) -> DataFrame:
    """One row per word and one without a word per text."""
    none = F.struct(F.lit(None).cast("string").alias("word"), F.lit(1).cast("long").alias("tf"))
    each = texts.select("own", F.explode(F.array_append("words", none)).alias("w"))
    return each.select("own", "w.word", (sign * F.col("w.tf")).alias("tf"), F.lit(sign).cast("long").alias("df"))


def _latest(terms: DataFrame) -> DataFrame:
    """The row of every key's latest update."""
    newest = terms.groupBy("review_id").agg(F.max("update").alias("update"))
    return terms.join(newest, ["review_id", "update"])


def update_keywords(
    spark: SparkSession,
    root: str,
    rows: DataFrame,
    text: str = "review_text",
    sentiment: str = "sentiment_label",
    stop_words: Sequence[str] = STOP_WORDS,
) -> int:
    """Take an upload into the state below ``root``; a key seen before replaces its text. Returns the new version.

    Keys are unique in an upload. A null text, or one without words, takes its key's words away. When the update fails, the
    state before holds.
    """
    before = dataset(spark, root)
    update = before.version + 1 if before else 1
    new = materialise(_counted(rows, text, sentiment, stop_words), "keyword-texts")
    changes = _signed(new, 1)
    if before:
        touched = before.read("terms").join(new.select("review_id"), "review_id", "left_semi")
        changes = changes.unionByName(_signed(_latest(touched), -1))
    summed = changes.groupBy("own", "word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where("tf != 0 or df != 0")
    folder = f"update-{uuid.uuid4().hex}"
    new.withColumn("update", F.lit(update).cast("long")).write.parquet(f"{root.rstrip('/')}/{folder}/terms")
    summed.write.parquet(f"{root.rstrip('/')}/{folder}/changes")
    known = before.tables if before else {"terms": [], "changes": []}
    return commit(spark, root, {name: [*known[name], f"{folder}/{name}"] for name in ("terms", "changes")})


def merge_updates(spark: SparkSession, root: str) -> int:
    """Replace the state's folders by one of each table with the same sums."""
    found = dataset(spark, root)
    folder = f"merged-{uuid.uuid4().hex}"
    _latest(found.read("terms")).write.parquet(f"{found.root}/{folder}/terms")
    _totals(found.read("changes")).write.parquet(f"{found.root}/{folder}/changes")
    return commit(spark, root, {name: [f"{folder}/{name}"] for name in ("terms", "changes")})


def _totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("own", "word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where("tf != 0 or df != 0")


def current_counts(spark: SparkSession, root: str) -> DataFrame:
    """``(class, word, count, df)`` of all words."""
    totals = _totals(dataset(spark, root).read("changes")).where(F.col("word").isNotNull())
    return roll_up(totals.withColumnRenamed("tf", "count"), ["word"], ["count", "df"])


def current_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``(class, documents)``."""
    totals = _totals(dataset(spark, root).read("changes")).where(F.col("word").isNull())
    return roll_up(totals.withColumnRenamed("tf", "documents"), [], ["documents"])


def current_keywords(spark: SparkSession, root: str, n: int = TOP_N) -> DataFrame:
    """``(class, rank, word, count)``: the lists of :func:`~reviewlens.operators.keywords.keyword_frequencies` over the current texts."""
    return top_per_class(current_counts(spark, root), F.col("count"), n).select("class", "rank", "word", "count")
