"""Versions of data sets, keyword counts by changes, phrases from a table, remembered tables."""

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import ASPECTS
from reviewlens.functions.rules import aspects_or_general
from reviewlens.operators import keyword_state, keywords, phrases
from reviewlens.sources import datasets, scratch


def numbers(spark, n):
    return spark.range(n).withColumn("x", F.col("id") * 2)


def test_a_reader_sees_a_whole_old_or_a_whole_new_set(spark, tmp_path):
    root = str(tmp_path / "sets")
    assert datasets.dataset(spark, root) is None
    first = datasets.publish({"a": numbers(spark, 3), "b": numbers(spark, 4)}, root)
    held = datasets.dataset(spark, root)
    broken = numbers(spark, 9).withColumn("x", F.raise_error(F.lit("no such table")).cast("long"))
    with pytest.raises(Exception, match="no such table"):
        datasets.publish({"a": numbers(spark, 7), "b": broken}, root)
    now = datasets.dataset(spark, root)
    assert (now.version, now.read("a").count(), now.read("b").count()) == (first, 3, 4)
    second = datasets.publish({"a": numbers(spark, 5), "b": numbers(spark, 6)}, root)
    assert [datasets.dataset(spark, root).read(t).count() for t in "ab"] == [5, 6]
    assert [held.read(t).count() for t in "ab"] == [3, 4]  # as resolved before
    third = datasets.rollback(spark, root, first)
    assert (second, third) == (first + 1, first + 2)
    assert [datasets.dataset(spark, root).read(t).count() for t in "ab"] == [3, 4]
    # The first version's folders are still named by the third.
    assert datasets.release_versions(spark, root, keep=1) == [first, second]
    assert [datasets.dataset(spark, root).read(t).count() for t in "ab"] == [3, 4]
    assert not list((tmp_path / "sets").glob("_manifests/*.tmp"))
    datasets.serve(datasets.dataset(spark, root))
    assert spark.table("b").count() == 4
    spark.catalog.dropTempView("a")
    spark.catalog.dropTempView("b")


def test_numbers_of_versions_are_never_taken_twice(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    datasets.commit(spark, root, {"a": ["one"]})
    real, asked = datasets._versions, []

    def late(spark, root):  # what a second writer saw before the first one's commit
        asked.append(1)
        return [] if len(asked) == 1 else real(spark, root)

    monkeypatch.setattr(datasets, "_versions", late)
    assert datasets.commit(spark, root, {"a": ["two"]}) == 2
    assert datasets.dataset(spark, root, 1).tables == {"a": ["one"]}


def test_keyword_changes_equal_counting_anew(spark, tmp_path):
    root = str(tmp_path)
    schema = "review_id string, review_text string, sentiment_label string"
    uploads = [
        [("a", "good good phone", "Positive"), ("b", "bad phone", "Negative"), ("c", "phone", None), ("d", None, "Positive")],
        [("e", "good camera", "Positive"), ("b", "fine phone now", "Positive")],
        [("c", "", "Negative"), ("f", "camera camera", "Negative"), ("b", "gone", "Negative")],
    ]
    now = {}
    for rows in uploads:
        keyword_state.update_keywords(spark, root, spark.createDataFrame(rows, schema))
        now |= {row[0]: row for row in rows}
        texts = spark.createDataFrame(list(now.values()), schema)
        wanted = sorted(keywords.keyword_frequencies(texts, "review_text", "sentiment_label").collect())
        assert sorted(keyword_state.current_keywords(spark, root).collect()) == wanted
        sizes = {r["class"]: r.documents for r in keyword_state.current_sizes(spark, root).collect()}
        assert sizes["top"] == len(now)
    keyword_state.merge_updates(spark, root)
    assert sorted(keyword_state.current_keywords(spark, root).collect()) == wanted
    assert len(datasets.dataset(spark, root).tables["terms"]) == 1
    # What is replaced after merging is still known.
    keyword_state.update_keywords(spark, root, spark.createDataFrame([("f", "tablet", "Positive")], schema))
    words = {r.word for r in keyword_state.current_keywords(spark, root).collect()}
    assert "tablet" in words and {r["class"] for r in keyword_state.current_counts(spark, root).where("word = 'camera'").collect()} == {"positive", "top"}


def test_phrases_equal_patterns(spark):
    texts = ["Dark mode is ugly", "dark  mode, match-making", "super like!", None, "", "not working; update", "matches", "a UI/UX thing", "fixed fix"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, clean_text string")
    table = phrases.phrase_table(spark.createDataFrame([(n, p) for n, own in ASPECTS.items() for p in own], "name string, phrase string"))
    got = {}
    for r in phrases.tagged(df, table).collect():
        got.setdefault(r.review_id, set()).add(r.aspect)
    wanted = df.select("review_id", aspects_or_general(F.col("clean_text")).alias("found"))
    assert got == {r.review_id: set(r.found or ["General"]) for r in wanted.collect()}


def test_longest_phrase_wins_and_the_plan_does_not_grow(spark):
    rows = [("x", "new york"), ("y", "new york city"), ("z", "York City"), ("x", "new york")]
    df = spark.createDataFrame([(1, "New York City and new york")], "review_id int, clean_text string")
    few = phrases.phrase_table(spark.createDataFrame(rows, "name string, phrase string"))
    every = sorted((r.pos, r.name) for r in phrases.phrase_matches(df, few).collect())
    assert every == [(1, "x"), (1, "y"), (3, "z"), (9, "x")]
    assert sorted((r.pos, r.name) for r in phrases.phrase_matches(df, few, longest=True).collect()) == [(1, "y"), (3, "z"), (9, "x")]
    many = spark.range(100_000).selectExpr("concat('n', id) as name", "concat('word', id, ' of ', id % 7) as phrase")
    texts = spark.range(500).selectExpr("id as review_id", "concat('A word', id * 200, ' of ', (id * 200) % 7, ' and word', id, ' of 9') as clean_text")
    found = phrases.phrase_matches(texts, phrases.phrase_table(many))
    assert sorted(r.name for r in found.select("name").collect()) == sorted(f"n{i * 200}" for i in range(500))
    plans = [phrases.phrase_matches(texts, t)._jdf.queryExecution().optimizedPlan().toString() for t in (few, phrases.phrase_table(many))]
    assert plans[0].count("\n") == plans[1].count("\n")
    assert len(plans[1]) < 30_000  # the filter's 1,024 numbers
    with pytest.raises(Exception, match="whole words"):
        phrases.phrase_table(spark.createDataFrame([("x", "ads!")], "name string, phrase string")).collect()


def test_remembered_tables_are_made_again_after_release(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert [scratch.remembered(spark, "three", build).count() for _ in range(2)] == [3, 3] and len(made) == 1
    scratch.release(spark)
    assert scratch.remembered(spark, "three", build).count() == 3 and len(made) == 2
