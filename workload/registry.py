"""Registered queries: one function per operator family, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions import rules, text
from reviewlens.functions.lexicons import ASPECTS
from reviewlens.operators import anomalies, aspects, baselines, emoji, evaluation, features, keyword_state, keywords, naive_bayes, phrases, scoring
from reviewlens.operators.keys import first_rows, seeded_sample, stratified_split
from reviewlens.operators.similarity import near_duplicate_ids
from reviewlens.plans import dashboard, insights, reports
from reviewlens.session import scratch_path
from reviewlens.sources import bucketed, datasets, ingest, paged, tables
from reviewlens.sources.scratch import KEPT, materialise, remembered
from reviewlens.streaming import trends, uploads
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------------


# Flags and scored reviews, as long as they are kept.
_FLAGS = KEPT


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag table under all three rules, written once per application and read by every query."""

    def build() -> DataFrame:  # looks for near-duplicates at once
        return reports.spam_report(views.reviews(spark, sf_dir)).select("review_id", "is_spam")

    return remembered(spark, f"flags of {sf_dir}", build)


def _scored(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """Every review cleaned and with the rule-based scorer's label, written once and read by every report.

    Not ``stored``, it is only written if another query has done so: one read of few columns is not worth two texts of
    every review on disk.
    """
    name = f"scored reviews of {sf_dir}"
    rows = reports.scored_reviews(views.worded_reviews(spark, sf_dir), scoring.lexicon_scorer("clean_text")).drop("sentiment_scores")
    if not stored and (spark.sparkContext.applicationId, name) not in KEPT:
        return rows
    return remembered(spark, name, lambda: rows)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.enriched_reviews(
        views.reviews(spark, sf_dir), views.mismatches(spark, sf_dir), _flags(spark, sf_dir)
    )


def _aspect_rows(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """Aspects of every scorable review, with the rule-based scorer's labels; four digits of confidence."""
    rows = reports.aspects_of_scored(_scored(spark, sf_dir, stored))
    return rows.withColumn("confidence", F.bround("confidence", 4))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review with its cleaned text and the rule-based scorer's label."""
    return _scored(spark, sf_dir).select("seq", "review_id", "clean_text", F.col("sentiment_label").alias("sentiment"))


def _keyword_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.distinct_texts(_labelled(spark, sf_dir))


# --- dashboard ---------------------------------------------------------------------


@query
def summary(spark, sf_dir):
    return dashboard.summary(
        views.reviews(spark, sf_dir),
        _aspect_rows(spark, sf_dir, stored=False),
        _flags(spark, sf_dir),
        views.mismatches(spark, sf_dir),
    )


@query
def trends_daily(spark, sf_dir):
    return dashboard.daily_trends(_enriched(spark, sf_dir))


@query
def reviews_enriched(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query
def reviews_first_row(spark, sf_dir):
    """Each result table holds two rows per review that disagree; of even reviews the second one stands first."""
    number = F.col("review_id").cast("long")

    def twice(df, **other):
        placed = df.withColumn("at", 2 * number)
        return placed.unionByName(placed.withColumns({**other, "at": 2 * number + F.when(number % 2 == 0, -1).otherwise(1)}))

    label = F.when(F.col("sentiment_label") == "Positive", "Negative").when(F.col("sentiment_label") == "Negative", "Positive")
    mismatches = twice(views.mismatches(spark, sf_dir), sentiment_label=label, is_mismatch=~F.col("is_mismatch"))
    flags = twice(_flags(spark, sf_dir), is_spam=~F.col("is_spam"))
    return dashboard.enriched_reviews(views.reviews(spark, sf_dir), mismatches, flags, keep_opinions=False, order="at")


@query
def reviews_bucketed(spark, sf_dir):
    """The review view over three tables in buckets of the review id: joins and first rows without a shuffle."""
    root = scratch_path(spark, "bucketed")
    found = {
        "raw_reviews": views.reviews(spark, sf_dir),
        "mismatches": views.mismatches(spark, sf_dir).select("review_id", "sentiment_label", "sentiment_score", "is_mismatch"),
        "flagged_reviews": _flags(spark, sf_dir),
    }
    bucketed.write_bucketed(found, root, 32)
    view = dashboard.enriched_reviews(*[bucketed.read_bucketed(spark, root, name) for name in found])
    # The view knows its files and buckets; the catalog need not.
    bucketed.forget_bucketed(spark, root, list(found))
    return view


@query
def reviews_filtered(spark, sf_dir):
    matching = dashboard.matching_reviews(
        _enriched(spark, sf_dir), sentiment="Positive", min_stars=1, max_stars=2, is_mismatch=True, is_spam=False
    )
    return dashboard.review_items(matching)


@query
def reviews_page(spark, sf_dir):
    matching = dashboard.matching_reviews(_enriched(spark, sf_dir), min_stars=2)
    return dashboard.reviews_page(matching, "seq", page=3, page_size=20)


@query
def reviews_pages_stored(spark, sf_dir):
    """A deep page of all reviews and the second one of mismatches, each from the ranges that hold it."""
    root = scratch_path(spark, "paged")
    paged.write_paged(_enriched(spark, sf_dir), "seq", root, {"mismatch": F.col("is_mismatch")}, ranges=16)
    deep = paged.read_page(spark, root, "seq", 8)
    second = paged.read_page(spark, root, "seq", 2, 5, "mismatch", F.col("is_mismatch"))
    items = [
        dashboard.review_items(rows).withColumns({"filter": F.lit(name), "total": F.lit(paged.matching_rows(spark, root, name)).cast("long")})
        for rows, name in ((deep, paged.ALL), (second, "mismatch"))
    ]
    return items[0].unionByName(items[1])


@query
def reviews_after(spark, sf_dir):
    matching = dashboard.matching_reviews(_enriched(spark, sf_dir), **dashboard.PRESETS["negative"])
    return dashboard.review_items(dashboard.reviews_after(matching, "seq", 100, 25))


@query
def reviews_total(spark, sf_dir):
    return dashboard.reviews_total(_enriched(spark, sf_dir), 20)


@query
def mismatch_list(spark, sf_dir):
    return dashboard.mismatch_list(views.mismatches(spark, sf_dir))


@query
def mismatch_breakdown(spark, sf_dir):
    labelled = scoring.joined_scorer(views.sentiments(spark, sf_dir))
    return anomalies.mismatch_breakdown(reports.mismatch_report(views.reviews(spark, sf_dir), labelled))


@query
def mismatch_table(spark, sf_dir):
    report = reports.mismatches_of(_scored(spark, sf_dir))
    return reports.mismatch_table(report).withColumn("sentiment_score", F.bround("sentiment_score", 4))


@query
def compare_apps(spark, sf_dir):
    return dashboard.compare_apps(views.reviews(spark, sf_dir), _aspect_rows(spark, sf_dir))


@query
def app_names(spark, sf_dir):
    return dashboard.app_names(views.reviews(spark, sf_dir))


# --- aspects -----------------------------------------------------------------------


@query
def aspect_rows(spark, sf_dir):
    return _aspect_rows(spark, sf_dir)


@query
def aspect_tags(spark, sf_dir):
    """The same aspects, from a table of phrases."""
    listed = spark.createDataFrame([(name, phrase) for name, own in ASPECTS.items() for phrase in own], "name string, phrase string")
    texts = _aspect_rows(spark, sf_dir).select("review_id", "clean_text").distinct()
    return phrases.tagged(texts, phrases.phrase_table(listed))


@query
def aspect_summary(spark, sf_dir):
    return aspects.aspect_summary(_aspect_rows(spark, sf_dir))


@query
def aspect_crosstab(spark, sf_dir):
    return aspects.aspect_crosstab(_aspect_rows(spark, sf_dir))


# --- text --------------------------------------------------------------------------


@query
def clean_model(spark, sf_dir):
    return views.texts(spark, sf_dir).select("id", text.clean_for_model(F.col("text")).alias("clean_text"))


@query
def clean_model_emoji(spark, sf_dir):
    rows = views.texts_with_emoji(spark, sf_dir)
    return emoji.clean_for_model_with_names(rows, views.emoji_names(spark), "id", "text").select("id", "clean_text")


@query
def clean_keywords(spark, sf_dir):
    return views.texts(spark, sf_dir).select("id", text.clean_for_keywords(F.col("text")).alias("clean_text"))


@query
def clean_features(spark, sf_dir):
    return views.texts(spark, sf_dir).select("id", text.clean_for_features(F.col("text")).alias("clean_text"))


@query
def feature_text(spark, sf_dir):
    return features.clean_reviews(views.texts(spark, sf_dir), "text").select("id", "clean_text")


@query
def feature_text_lemmas(spark, sf_dir):
    rows = views.texts(spark, sf_dir)
    words = rows.select(F.explode(text.feature_tokens(F.col("text"))).alias("token"))
    lemmas = features.plural_lemmas(words)
    return features.clean_reviews_with_lemmas(rows, lemmas, "id", "text").select("id", "clean_text")


@query
def feature_rows_filtered(spark, sf_dir):
    _, counts = features.clean_and_count(views.texts(spark, sf_dir), "text")
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counts.items()])


@query
def text_measures(spark, sf_dir):
    c = F.col("text")
    return views.texts(spark, sf_dir).select(
        "id",
        text.word_count(c).alias("words"),
        text.char_length(c).alias("chars"),
        F.size(text.word_tokens(c)).alias("word_tokens"),
        F.size(F.array_distinct(text.tokens(F.lower(c)))).alias("distinct_tokens"),
        F.array_join(text.keyword_tokens(c), " ").alias("keywords"),
    )


# --- anomalies ---------------------------------------------------------------------


@query
def short_flag(spark, sf_dir):
    return views.texts(spark, sf_dir).select("id", rules.is_too_short(F.col("text")).alias("is_short"))


@query
def repetition_flag(spark, sf_dir):
    return views.texts(spark, sf_dir).select("id", rules.is_repetitive(F.col("text")).alias("is_repetitive"))


@query
def near_duplicates(spark, sf_dir):
    return near_duplicate_ids(views.reviews(spark, sf_dir))


@query
def spam_report(spark, sf_dir):
    return reports.spam_table(reports.spam_report(views.reviews(spark, sf_dir)))


@query
def spam_breakdown(spark, sf_dir):
    return anomalies.spam_breakdown(reports.spam_report(views.reviews(spark, sf_dir)))


# --- keywords ----------------------------------------------------------------------


@query
def keywords_freq(spark, sf_dir):
    return keywords.keyword_frequencies(_keyword_texts(spark, sf_dir))


@query
def keywords_tfidf(spark, sf_dir):
    return keywords.keyword_tfidf(_keyword_texts(spark, sf_dir))


@query
def keywords_merged(spark, sf_dir):
    return reports.keyword_report(_labelled(spark, sf_dir))


@query
def keywords_true_counts(spark, sf_dir):
    texts = _keyword_texts(spark, sf_dir)
    return keywords.merge_keywords(keywords.keyword_tfidf(texts), keywords.word_frequencies(texts))


@query
def keywords_nested(spark, sf_dir):
    path = scratch_path(spark, "keyword-lists")
    tables.write_keyword_lists(keywords.keyword_lists(keywords.keyword_frequencies(_keyword_texts(spark, sf_dir))), path)
    return keywords.keyword_rows(tables.read_keyword_lists(spark, path))


@query
def keywords_frequent(spark, sf_dir):
    return keywords.keyword_frequencies(_keyword_texts(spark, sf_dir), n=30, min_count=5)


@query
def keywords_updated(spark, sf_dir):
    """Three uploads, then one that replaces every tenth text; counts are changed, not taken anew."""
    root = scratch_path(spark, "keyword-state")
    rows = _scored(spark, sf_dir).select("seq", "review_id", "review_text", "sentiment_label")
    for part in range(3):
        keyword_state.update_keywords(spark, root, rows.where(F.col("seq") % 3 == part))
    other = F.when(F.col("sentiment_label") == "Positive", "Negative").otherwise("Positive")
    renewed = rows.where("seq % 10 = 0").withColumns({"review_text": F.concat(F.lit("renewed edition "), "review_text"), "sentiment_label": other})
    keyword_state.update_keywords(spark, root, renewed)
    keyword_state.merge_updates(spark, root)
    return keyword_state.current_keywords(spark, root)


@query
def labelled_texts_fallback(spark, sf_dir):
    """Keyword texts where only the mismatch table is there."""
    return tables.labelled_texts(None, views.mismatches(spark, sf_dir), spark)


@query
def upload_keywords(spark, sf_dir):
    rows = scoring.lexicon_scorer()(views.worded_reviews(spark, sf_dir))
    return keywords.keyword_frequencies(rows, "review_text", "sentiment_label")


# --- labels and models -------------------------------------------------------------


@query
def weak_labels(spark, sf_dir):
    stars = F.col("star_rating")
    return views.reviews(spark, sf_dir).select(
        "review_id", rules.weak_label(stars).alias("sentiment"), rules.weak_label_index(stars).alias("label")
    )


@query
def clean_reviews_table(spark, sf_dir):
    root = scratch_path(spark, "clean-reviews")
    tables.write_table(features.clean_reviews(views.reviews(spark, sf_dir)), root, "clean_reviews")
    return tables.read_table(spark, root, "clean_reviews")


def _training_rows(spark, sf_dir):
    cleaned = features.clean_reviews(views.reviews(spark, sf_dir))
    return baselines.training_rows(cleaned)


def _stored_training_rows(spark, sf_dir):
    return remembered(spark, f"training rows of {sf_dir}", lambda: _training_rows(spark, sf_dir))


@query
def class_distribution(spark, sf_dir):
    return evaluation.class_distribution(_training_rows(spark, sf_dir), "sentiment")


@query
def stratified_split_counts(spark, sf_dir):
    split = stratified_split(_stored_training_rows(spark, sf_dir), "sentiment", "review_id")
    return split.groupBy("sentiment", "is_test").agg(F.count(F.lit(1)).alias("count"))


@query
def split_membership(spark, sf_dir):
    split = stratified_split(_stored_training_rows(spark, sf_dir), "sentiment", "review_id")
    return split.select("review_id", "sentiment", "is_test")


@query
def sampled_reviews(spark, sf_dir):
    return seeded_sample(views.reviews(spark, sf_dir), "review_id", 500)


@query
def lexicon_scores(spark, sf_dir):
    scored = scoring.lexicon_scorer()(views.worded_reviews(spark, sf_dir))
    return scored.select(
        "review_id",
        "sentiment_label",
        F.bround("sentiment_score", 4).alias("sentiment_score"),
        F.bround(F.col("sentiment_scores")["Positive"], 4).alias("positive_score"),
    )


def _judged(spark, sf_dir):
    """Sentiments as labels against the rule-based scorer's predictions."""
    scored = scoring.lexicon_scorer()(views.worded_reviews(spark, sf_dir))
    truth = views.sentiments(spark, sf_dir).select("review_id", F.col("sentiment_label").alias("label"))
    return scored.join(truth, "review_id").select(
        "label",
        F.col("sentiment_label").alias("prediction"),
        (F.col("label") == "Positive").alias("is_positive"),
        F.col("sentiment_scores")["Positive"].alias("score"),
    )


@query
def confusion_counts(spark, sf_dir):
    return evaluation.confusion_matrix(_judged(spark, sf_dir))


@query
def class_scores(spark, sf_dir):
    scores = evaluation.class_scores(_judged(spark, sf_dir))
    return scores.select(
        "class", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", "hits"
    )


@query
def accuracy_macro_f1(spark, sf_dir):
    scores = evaluation.accuracy_and_macro_f1(_judged(spark, sf_dir))
    return scores.select(F.bround("accuracy", 6).alias("accuracy"), F.bround("macro_f1", 6).alias("macro_f1"))


@query
def roc_auc_exact(spark, sf_dir):
    """Review length as the score of the positive label: few ties, wide range."""
    rows = views.scored(views.reviews(spark, sf_dir), spark, sf_dir).select(
        (F.col("sentiment_label") == "Positive").alias("is_positive"),
        (F.length("review_text") / 1000.0).alias("score"),
    )
    return evaluation.roc_auc(rows).select(F.bround("roc_auc", 6).alias("roc_auc"))


@query
def metrics_table(spark, sf_dir):
    """The rule-based scorer's row of the metrics table, as written and read."""
    judged = _judged(spark, sf_dir).withColumn("model", F.lit("lexicon"))
    figures = evaluation.accuracy_and_macro_f1(judged, by=["model"]).join(evaluation.roc_auc(judged, by=["model"]), "model")
    root = scratch_path(spark, "metrics")
    tables.write_table(figures, root, "metrics")
    rounded = [F.bround(c, 6).alias(c) for c in ("accuracy", "macro_f1", "roc_auc")]
    return tables.read_table(spark, root, "metrics").select("model", *rounded)


@query
def baseline_metrics(spark, sf_dir):
    cleaned = features.clean_reviews(views.reviews(spark, sf_dir))
    return baselines.compare_baselines(cleaned)


def _bayes(spark, sf_dir):
    """Reviews of the test part with label, prediction and probability of the positive label."""
    split = materialise(stratified_split(_stored_training_rows(spark, sf_dir), "sentiment", "review_id"), "split")
    model = materialise(naive_bayes.fit_naive_bayes(split.where("not is_test"), label="sentiment"), "bayes-model")
    test = split.where("is_test")
    guessed = naive_bayes.predict_naive_bayes(model, test)
    positive = F.get(F.filter("probabilities", lambda p: p["class"] == "Positive"), F.lit(0))["probability"]
    # Equal texts get equal scores whatever the order of their sums.
    return guessed.join(test.select("review_id", F.col("sentiment").alias("label")), "review_id").select(
        "review_id",
        "label",
        "prediction",
        (F.col("label") == "Positive").alias("is_positive"),
        F.bround(positive, 9).alias("score"),
    )


@query
def naive_bayes_model(spark, sf_dir):
    """The fitted table itself: IDF and log-probability per term and class."""
    model = naive_bayes.fit_naive_bayes(_stored_training_rows(spark, sf_dir), label="sentiment", max_features=2000)
    return model.select("term", "class", *[F.bround(c, 6).alias(c) for c in ("idf", "log_probability", "log_prior")])


@query
def naive_bayes_predictions(spark, sf_dir):
    return _bayes(spark, sf_dir).select("review_id", "label", "prediction", F.bround("score", 6).alias("score"))


@query
def naive_bayes_metrics(spark, sf_dir):
    judged = materialise(_bayes(spark, sf_dir).withColumn("model", F.lit("Naive_Bayes")), "judged")
    figures = evaluation.accuracy_and_macro_f1(judged, by=["model"]).join(evaluation.roc_auc(judged, by=["model"]), "model")
    return figures.select("model", *[F.bround(c, 6).alias(c) for c in ("accuracy", "macro_f1", "roc_auc")])


# --- ingest ------------------------------------------------------------------------


@query
def reviews_from_csv(spark, sf_dir):
    path = scratch_path(spark, "reviews-csv")
    views.reviews(spark, sf_dir).drop("seq").write.option("header", True).option("escape", '"').csv(path)
    return ingest.read_raw_reviews(spark, path)


@query
def store_export(spark, sf_dir):
    exported = views.reviews(spark, sf_dir).selectExpr(
        "review_id as reviewId", "review_text as content", "star_rating as score", "review_date as at", "app_name as app"
    )
    first = exported.where("app < 'src2'").drop("app")
    second = exported.where("app is null or app >= 'src2'").selectExpr("* except (app)", "if(app is null, null, 1) as thumbsUpCount")
    return ingest.conform_store_export(ingest.union_apps({"one": first, "two": second}))


@query
def upload_normalised(spark, sf_dir):
    rows = ingest.conform_upload(views.upload(spark, sf_dir), F.lit("2025-06-30").cast("date"), order="line")
    return rows.select("review_id", "review_text", "star_rating", "app_name", "review_date", "role")


@query
def upload_capped(spark, sf_dir):
    """The first 200 rows of an upload without dates or ratings."""
    rows = first_rows(views.upload(spark, sf_dir).select("line", "`Content [message text]`"), "line", 200)
    made = ingest.conform_upload(rows, F.lit("2025-06-30").cast("date"), order="line")
    return made.select("review_id", "review_text", "star_rating", "app_name", "review_date")


@query
def upload_scored(spark, sf_dir):
    rows = uploads.score_upload(
        views.upload(spark, sf_dir), scoring.lexicon_scorer(), F.lit("2025-06-30").cast("date"), order="line"
    )
    return rows.select(
        "review_id", "sentiment_label", F.bround("sentiment_score", 4).alias("sentiment_score"), "is_mismatch", "is_spam"
    )


@query
def upload_stream(spark, sf_dir):
    root = scratch_path(spark, "upload-stream")
    rows = views.upload(spark, sf_dir)
    rows.write.option("header", True).option("escape", '"').csv(f"{root}/in")
    schema = ingest.csv_schema(spark, f"{root}/in")
    uploads.stream_uploads(
        spark,
        f"{root}/in",
        schema,
        f"{root}/out",
        scoring.lexicon_scorer(),
        f"{root}/checkpoint",
        F.lit("2025-06-30").cast("date"),
    ).awaitTermination()
    scored = spark.read.parquet(f"{root}/out/scored")
    return scored.groupBy("sentiment_label", "is_mismatch", "is_spam").agg(F.count(F.lit(1)).alias("reviews"))


@query
def upload_quarantine(spark, sf_dir):
    """An upload without header line in which every fifth record is short, long, not UTF-8 or holds a legal U+FFFD."""
    path = scratch_path(spark, "upload-quarantine")
    views.raw_upload(spark, sf_dir).write.option("lineSep", "\n").text(path)
    read = ingest.read_csv(spark, path, columns=["line", "text", "role"])
    bad = read.quarantine.select(
        F.substring_index("_corrupt_record", ",", 1).alias("line"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("role"), "_reason"
    )
    rows = read.rows.withColumn("_reason", F.lit(None).cast("string")).unionByName(bad)
    return rows.select("line", "text", "role", F.col("_reason").alias("reason"))


@query
def dataset_swap(spark, sf_dir):
    """Key figures of an applied upload, from the tables then served."""
    scored = uploads.score_upload(
        views.upload(spark, sf_dir), scoring.lexicon_scorer(), F.lit("2025-06-30").cast("date"), order="line"
    )
    root = scratch_path(spark, "served")
    served = reports.upload_tables(scored)
    tables.publish_dataset(served, root, "latest")
    read = {name: tables.read_table(spark, f"{root}/latest", name) for name in served}
    return dashboard.summary(
        read["raw_reviews"], read["aspect_results"], read["flagged_reviews"], read["mismatches"]
    )


@query
def dataset_versions(spark, sf_dir):
    """Rows per table of three versions: all uploads, those of users, and the first again."""
    scored = uploads.score_upload(
        views.upload(spark, sf_dir), scoring.lexicon_scorer(), F.lit("2025-06-30").cast("date"), order="line"
    )
    root = scratch_path(spark, "versions")
    everything = reports.upload_tables(scored.drop("sentiment_scores"))
    first = datasets.publish(everything, root)
    datasets.publish(reports.upload_tables(scored.where("role = 'user'").drop("sentiment_scores")), root)
    seen = [datasets.dataset(spark, root, first), datasets.dataset(spark, root)]
    datasets.rollback(spark, root, first)
    seen.append(datasets.dataset(spark, root))
    counts = [
        found.read(name).agg(F.lit(found.version).cast("long").alias("version"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for found in seen
        for name in ("raw_reviews", "mismatches", "aspect_results")
    ]
    table = counts[0]
    for more in counts[1:]:
        table = table.unionByName(more)
    return table


@query
def stream_trends(spark, sf_dir):
    root = scratch_path(spark, "trend-stream")
    schema = views.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    positive, negative = F.col("event_type") == "purchase", F.col("event_type") == "error"
    trends.upsert_daily_counts(
        events, "ts", positive, negative, f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return trends.read_daily_counts(spark.read.parquet(f"{root}/out"))


# --- further figures ---------------------------------------------------------------


@query
def date_range(spark, sf_dir):
    return insights.date_range(views.reviews(spark, sf_dir))


@query
def top_words(spark, sf_dir):
    return keywords.keyword_frequencies(_keyword_texts(spark, sf_dir), n=3)


@query
def sentiment_index(spark, sf_dir):
    return insights.sentiment_index(_enriched(spark, sf_dir))


@query
def monthly_trends(spark, sf_dir):
    return insights.monthly_trends(_enriched(spark, sf_dir))


@query
def trends_with_releases(spark, sf_dir):
    daily = dashboard.daily_trends(_enriched(spark, sf_dir))
    return insights.trends_with_releases(daily, views.releases(spark, sf_dir))


@query
def recent_reviews(spark, sf_dir):
    return insights.last_days(views.reviews(spark, sf_dir), 30)


@query
def representative_reviews(spark, sf_dir):
    return insights.representative_reviews(_aspect_rows(spark, sf_dir)).select(
        "aspect", "rank", "review_id", "sentiment", "confidence"
    )


@query
def app_aspect_matrix(spark, sf_dir):
    return insights.app_aspect_matrix(_aspect_rows(spark, sf_dir))


@query
def dominant_sentiment(spark, sf_dir):
    return insights.dominant_sentiment(aspects.aspect_summary(_aspect_rows(spark, sf_dir)))


@query
def anomaly_list(spark, sf_dir):
    found = insights.anomalies(
        _enriched(spark, sf_dir), since="2024-01-15", until="2024-03-15", kind="high_rating_negative"
    )
    return found.select("review_id", "app_name", "review_date", "mismatch_kind", "is_mismatch", "is_spam")


@query
def review_search(spark, sf_dir):
    return insights.search_reviews(views.worded_reviews(spark, sf_dir), "Dark Mode").select("review_id", "app_name")


@query
def aspect_maps(spark, sf_dir):
    maps = insights.aspect_map_per_review(_aspect_rows(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("aspect_sentiments")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("review_id", F.array_join(pairs, ";").alias("aspect_sentiments"))
