"""Multinomial Naive Bayes on TF-IDF features, fitted and applied with joins and sums.

A model is a table with one row per vocabulary term and class: the term's IDF and its log-probability in that
class. It is made of sums per (term, class), so fitting is two passes over term counts and needs no gradient, and
predicting is a join with a table of at most ``max_features`` rows per class, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.text import word_tokens
from reviewlens.operators.tfidf import smoothed_idf, term_counts, term_totals, vocabulary
from reviewlens.sources.scratch import materialise


def _features(counts: DataFrame, idf: DataFrame, key: str, *keep: str) -> DataFrame:
    """``(key, *keep, term, x)``: TF-IDF of the known terms, each text scaled to length one."""
    weighted = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    # Term counts are partitioned by key already.
    squares = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))
    return weighted.select(key, *keep, "term", (F.col("w") / F.sqrt(squares)).alias("x"))


def fit_naive_bayes(
    rows: DataFrame, key: str = "review_id", text: str = "text", label: str = "label", max_features: int = 50_000, smoothing: float = 1.0
) -> DataFrame:
    """``(term, class, idf, log_probability, log_prior)``, one row per vocabulary term and class.

    ``key`` is unique. Rows without a label take no part; a null or empty text counts for the prior alone. Without
    rows the model is empty.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("class"), F.col(text).alias("text"))
    counts = materialise(term_counts(known, "key", word_tokens(F.col("text")), "class"), "term-counts")
    sizes = known.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    # One row per class.
    priors = materialise(sizes.withColumn("all_rows", F.sum("rows").over(Window.partitionBy())), "priors")
    documents = priors.agg(F.max("all_rows")).scalar()
    terms = vocabulary(term_totals(counts), max_features).select("term", smoothed_idf(F.col("df"), documents).alias("idf"))
    terms = materialise(terms, "vocabulary")
    sums = _features(counts, terms, "key", "class").groupBy("term", "class").agg(F.sum("x").alias("mass"))
    # A term that a class has not seen still has the smoothing mass there: every pair is needed.
    classes = priors.agg(F.collect_list(F.struct("class", "rows", "all_rows"))).scalar()
    pairs = terms.withColumn("_classes", classes).select("term", "idf", F.inline("_classes"))
    full = pairs.join(sums, ["term", "class"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)) + smoothing)
    totals = full.groupBy("class").agg(F.sum("mass").alias("total"))
    return full.join(F.broadcast(totals), "class").select(
        "term",
        "class",
        "idf",
        F.ln(F.col("mass") / F.col("total")).alias("log_probability"),
        F.ln(F.col("rows") / F.col("all_rows")).alias("log_prior"),
    )


def class_log_scores(model: DataFrame, rows: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """``(key, scores)``: an array of ``(class, score)``, by class, the joint log-probability of text and class.

    A text without any known term has the log-priors alone. Repeated keys are one text; null keys too.
    """
    known = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = term_counts(known, "key", word_tokens(F.col("text")))
    idf = model.groupBy("term").agg(F.first("idf").alias("idf"))
    weights = model.groupBy("term").agg(F.collect_list(F.struct("class", "log_probability")).alias("weights"))
    parts = _features(counts, idf, "key").join(F.broadcast(weights), "term").select("key", "x", F.inline("weights"))
    sums = parts.groupBy("key", "class").agg(F.sum(F.col("x") * F.col("log_probability")).alias("likelihood"))
    entry = F.struct("class", "likelihood")
    found = sums.groupBy("key").agg(F.collect_list(entry).alias("found"))
    priors = model.groupBy("class").agg(F.first("log_prior").alias("log_prior"))
    priors = priors.agg(F.sort_array(F.collect_list(F.struct("class", "log_prior"))).alias("priors")).scalar()

    def score(prior):
        own = F.filter("found", lambda f: f["class"] == prior["class"])
        return F.struct(
            prior["class"].alias("class"), (prior["log_prior"] + F.coalesce(F.get(own, F.lit(0))["likelihood"], F.lit(0.0))).alias("score")
        )

    keyed = known.select("key").distinct().join(found, "key", "left").withColumn("priors", priors)
    return keyed.select(F.col("key").alias(key), F.transform("priors", score).alias("scores"))


def predict_naive_bayes(model: DataFrame, rows: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """``(key, prediction, probabilities)``: the likeliest class (ties: the first) and ``(class, probability)`` by class."""
    scored = class_log_scores(model, rows, key, text)
    best = F.array_max(F.transform("scores", lambda s: s["score"]))
    shares = F.transform("scores", lambda s: F.struct(s["class"].alias("class"), F.exp(s["score"] - F.col("_best")).alias("share")))
    whole = F.reduce("_shares", F.lit(0.0), lambda total, s: total + s["share"])
    likely = F.get(F.filter("scores", lambda s: s["score"] == F.col("_best")), F.lit(0))["class"]
    ranked = scored.withColumn("_best", best).withColumn("_shares", shares)
    return ranked.select(
        key,
        likely.alias("prediction"),
        F.transform("_shares", lambda s: F.struct(s["class"].alias("class"), (s["share"] / whole).alias("probability"))).alias("probabilities"),
    )
