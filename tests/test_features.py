"""Lemmas by part vocabularies, counts observed while rows are written."""

import re

from pyspark.sql import functions as F

from reviewlens.functions.text import feature_tokens
from reviewlens.operators import features

WORDS = "chat filter photo people match message profile search swipe account".split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n=60):
    """A third of all rows holds one word a hundred times."""
    rows = [(str(i), " ".join((["filters"] * 100 if i % 3 == 0 else []) + [WORDS[(i * k) % 10] + "s" * (k % 2) for k in range(1, 9)])) for i in range(n)]
    return spark.createDataFrame([*rows, ("e", ""), ("n", None), (None, rows[1][1])], "review_id string, review_text string")


def test_lemmas_equal_a_lookup_per_token(spark):
    lemmas = {"filters": "filter", "photos": "photo", "peoples": "people"}
    table = spark.createDataFrame([*lemmas.items(), ("filters", "zzz"), ("matchs", None)], "token string, lemma string")
    rows = texts(spark)
    tokens = rows.where("review_id is not null").select("review_id", feature_tokens(F.col("review_text")).alias("t")).collect()
    plain = {r.review_id: " ".join(lemmas.get(t, t) for t in r.t) for r in tokens if r.t and len(r.t) >= 5}
    for options in ({}, {"most_broadcast": 0}, {"most_broadcast": 0, "part_bytes": 64}):
        got = features.clean_reviews_with_lemmas(rows, table, **options)
        assert got.columns == ["review_id", "review_text", "clean_text"]
        assert {r.review_id: r.clean_text for r in got.collect()} == plain
        assert features.clean_reviews_with_lemmas(rows.where("false"), table, **options).count() == 0


def test_no_occurrence_is_shuffled_by_token(spark):
    tokens = texts(spark).where("review_id is not null").select(
        "review_id", feature_tokens(F.col("review_text")).alias("_tokens"), F.pmod(F.xxhash64("review_id"), F.lit(4)).alias("_part")
    )
    encoded, vocabulary = features.dictionary_encoded(tokens, "review_id", 4)
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(encoded))
    assert keys and all("token" not in key for key in keys)
    # What a hot token sends to the join with lemmas is one row per part.
    assert vocabulary.where("token = 'filters'").count() <= 4
    assert vocabulary.count() == vocabulary.distinct().count()
    # Few lemmas are broadcast: no plan shuffles by token at all.
    table = spark.createDataFrame([("filters", "filter")], "token string, lemma string")
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(features.clean_reviews_with_lemmas(texts(spark), table)))
    assert keys and all("token" not in key for key in keys)


def test_counts_are_observed_by_the_one_write(spark):
    rows = texts(spark)
    cleaned, counts = features.clean_and_count(rows)
    assert counts == {"before": 63, "after": 61, "filtered_out": 2}
    assert cleaned.count() == 61 and cleaned.columns == ["review_id", "review_text", "clean_text"]
    _, none = features.clean_and_count(rows.where("false"))
    assert none == {"before": 0, "after": 0, "filtered_out": 0}
