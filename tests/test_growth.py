"""Steps whose memory, disk or time grew faster than the tables."""

import time

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text
from reviewlens.operators import anomalies, blocks, features, similarity, tfidf
from reviewlens.plans import dashboard, reports
from reviewlens.sources import paged, scratch
from workload import registry, views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_term_counts_follow_the_size_of_the_texts(spark, monkeypatch):
    """A part held more text the more there was, whatever its count needed in memory."""
    docs = spark.createDataFrame([(str(i), "some words " * 20) for i in range(50)] + [("x", None), (None, "words")], "key string, text string")
    few = tfidf.term_counts(docs, "key", F.split("text", " +"))
    monkeypatch.setattr(tfidf, "_PART_BYTES", 100)
    many = tfidf.term_counts(docs, "key", F.split("text", " +"))
    assert many.rdd.getNumPartitions() > 100
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    assert tfidf.term_counts(docs.limit(0), "key", F.split("text", " +")).count() == 0


def test_lemmas_of_plurals_clean_each_text_once(spark):
    """The words were made from the texts once for the plurals and once for their stems."""
    texts = spark.createDataFrame([("cats and a cat",), ("boxes in a box",), (None,)], "text string")
    lemmas = features.plural_lemmas(texts.select(F.explode(text.tokens(F.col("text"))).alias("token")))
    assert sorted(map(tuple, lemmas.collect())) == [("boxes", "box"), ("cats", "cat")]
    assert "Generate explode(filter" not in plan_of(lemmas) and "words-" in plan_of(lemmas)


@pytest.mark.parametrize("name", ["split_membership", "stratified_split_counts"])
def test_splits_read_stored_training_rows(spark, small, name):
    """Quotas, cutoffs and marks each cleaned every text anew."""
    from workload.registry import QUERIES

    scratch.release(spark)
    assert "regexp_replace" not in plan_of(QUERIES[name](spark, small))


def test_markup_is_looked_for_before_its_pattern(spark):
    given = ["no markup", "www", "wwwx y", "see http://a.b/c now", "ht<b>tp://x", "a < b", "a <b> c", "", None, "<\n>", "ttp ww w"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, text string")
    c = F.col("text")
    rows = df.select(
        text.strip_urls(c).alias("a"), F.regexp_replace(c, text._URL, "").alias("b"), text.strip_tags(c).alias("c"), F.regexp_replace(c, text._TAG, "").alias("d")
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)
    assert "contains" in plan_of(df.select(text.strip_urls(c))).lower()


def test_baseline_measures_read_stored_predictions(spark):
    """Every measure made features and predictions of all three models anew."""
    from reviewlens.operators import baselines

    rows = [(str(i), "good fine app" if i % 2 else "bad poor app", 5.0 if i % 2 else 1.0) for i in range(60)]
    reviews = spark.createDataFrame(rows, "review_id string, clean_text string, star_rating double")
    plan = plan_of(baselines.compare_baselines(reviews))
    assert "predictions-" in plan and "UDF" not in plan


def test_flags_look_for_near_duplicates_once(spark, small, monkeypatch):
    """Every query on flags looked for near-duplicates again, and left its tables behind."""
    scratch.release(spark)
    calls, found = [], reports.near_duplicate_ids
    monkeypatch.setattr(reports, "near_duplicate_ids", lambda *a: calls.append(1) or found(*a))
    assert registry.QUERIES["reviews_total"](spark, small).count() == 1
    assert registry.QUERIES["trends_daily"](spark, small).count() > 0
    assert len(calls) == 1
    scratch.release(spark)


def test_tables_on_the_way_to_near_duplicates_are_deleted(spark):
    docs = spark.createDataFrame([(str(i), f"word{i // 2} again and again") for i in range(8)], "review_id string, review_text string")
    scratch.release(spark)
    ids = similarity.near_duplicate_ids(docs)
    assert ids.count() == 8
    assert scratch.release(spark) == 1


def test_blocks_are_deleted_once_they_are_compared(spark, monkeypatch):
    """They stood beside the shuffles of the last checks."""
    docs = spark.createDataFrame([(str(i), f"one more word{i} than others") for i in range(8)], "review_id string, review_text string")
    there, found = [], similarity.verified_pairs

    def looked(*args):
        there.append([path for path in scratch._WRITTEN[spark.sparkContext.applicationId] if "/blocks-" in path])
        return found(*args)

    scratch.release(spark)
    monkeypatch.setattr(similarity, "verified_pairs", looked)
    similarity.near_duplicate_ids(docs).count()
    assert there == [[], []]
    scratch.release(spark)


def test_an_outcome_keeps_remembered_tables(spark):
    scratch.release(spark)
    one = lambda: scratch.remembered(spark, "one", lambda: scratch.materialise(spark.range(1), "way"))
    two = scratch.outcome("two", lambda: scratch.outcome("inner", lambda: one().union(scratch.materialise(spark.range(1), "way"))))
    assert two.count() == 2 and one().count() == 1
    scratch.release(spark)


def test_flags_do_not_move_texts(spark, small):
    reviews = views.reviews(spark, small)
    ids = reviews.select("review_id")
    flags = anomalies.flag_spam(reviews, ids.hint("shuffle_merge")).select("review_id", "is_spam")
    join = flags._jdf.queryExecution().optimizedPlan().children().head()
    assert "Join" in join.nodeName()
    assert "review_text" not in join.output().mkString(",")


def test_pages_of_given_ranges_are_stored_once(spark, tmp_path):
    scratch.release(spark)
    paged.write_paged(spark.range(50).withColumnRenamed("id", "seq"), "seq", str(tmp_path / "paged"), ranges=4)
    assert [r.seq for r in paged.read_page(spark, str(tmp_path / "paged"), "seq", 2, 5).collect()] == [5, 6, 7, 8, 9]
    assert scratch.release(spark) == 0


def test_bucketed_reviews_leave_no_tables_in_the_catalog(spark, small):
    before = {t.name for t in spark.catalog.listTables()}
    view = registry.QUERIES["reviews_bucketed"](spark, small)
    assert view.count() == views.reviews(spark, small).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in found.mkString(",").split(",") if "/shuffle_" in name}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """They stood until the driver collected garbage, which a driver with little to do may never do."""
    setting, before = spark.conf.get(scratch._CLEANUP), shuffle_files(spark)
    table = scratch.materialise(spark.range(100).repartition(3), "table")
    until = time.monotonic() + 10
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(scratch._CLEANUP) == setting
    assert table.count() == 100


def test_coded_texts_are_deleted_once_bags_stand(spark, monkeypatch):
    """Term numbers of every document stood beside those of the bags until the end."""
    docs = spark.createDataFrame([(str(i % 7), f"one more word{i} than others") for i in range(8)], "review_id string, review_text string")
    there, found = [], blocks.compared

    def looked(*args):
        there.extend(path.rsplit("/", 1)[1].split("-")[0] for path in scratch._WRITTEN[spark.sparkContext.applicationId])
        return found(*args)

    scratch.release(spark)
    monkeypatch.setattr(blocks, "compared", looked)
    assert similarity.near_duplicate_ids(docs).count() == 0
    assert "bags" in there and "members" in there and "coded" not in there
    assert scratch.release(spark) == 1


def test_a_page_moves_no_text_beyond_its_end(spark):
    """All texts after the last row seen went through the joins for a page of them."""
    raw = spark.createDataFrame([(i, f"r{i}", f"text {i}") for i in [None, None, *range(40), 7]], "seq long, review_id string, review_text string")
    label = raw.select("review_id").distinct().withColumn("label", F.when(F.col("review_id") != "r9", "x"))
    matching = raw.join(label.hint("shuffle_merge"), "review_id", "left").where("label = 'x'")
    for last, seqs in ((None, [None, None, 0, 1, 2, 3]), (5, [6, 7, 7, 8, 10, 11]), (37, [38, 39]), (39, [])):
        page = dashboard.reviews_after(matching, "seq", last, 6)
        assert [r.seq for r in page.collect()] == seqs
        plan = page._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join ") < plan.index("scalar-subquery")


def test_the_summary_stores_no_texts(spark, small):
    """It wrote both texts of every review to read two short columns of them."""
    scratch.release(spark)
    alone = registry.QUERIES["summary"](spark, small).collect()
    assert not [name for _, name in scratch.KEPT if name.startswith("scored reviews")]
    registry.QUERIES["aspect_summary"](spark, small).collect()
    again = registry.QUERIES["summary"](spark, small)
    assert "kept-" in plan_of(again) and again.collect() == alone
    scratch.release(spark)
