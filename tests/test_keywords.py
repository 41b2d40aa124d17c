import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import keywords
from reviewlens.plans import reports
from reviewlens.sources import tables

ROWS = [
    (0, "love this great app love", "Positive"),
    (1, "great matches great fun", "Positive"),
    (2, "crash crash after the update", "Negative"),
    (3, "too expensive and crash", "Negative"),
    (4, "love this great app love", "Negative"),  # same text as row 0: left out
    (5, "plain words", "Other"),
    (6, "", "Positive"),
    (7, "no label here", None),
]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(
        [(s, str(s), t, l) for s, t, l in ROWS], "seq long, review_id string, clean_text string, sentiment string"
    )


def by_class(df, *columns):
    found = {}
    for r in df.orderBy("class", "rank").collect():
        found.setdefault(r["class"], []).append(tuple(r[c] for c in columns))
    return found


def test_frequencies(labelled):
    found = by_class(keywords.keyword_frequencies(keywords.distinct_texts(labelled), n=3), "word", "count")
    assert found["positive"] == [("great", 3), ("love", 2), ("app", 1)]
    assert found["negative"] == [("crash", 3), ("expensive", 1), ("update", 1)]
    assert found["top"] == [("crash", 3), ("great", 3), ("love", 2)]


def test_tfidf_equals_direct_computation(labelled):
    texts = keywords.distinct_texts(labelled)
    found = by_class(keywords.keyword_tfidf(texts), "word", "tfidf")
    stop = set(keywords.STOP_WORDS)
    groups = {
        "positive": [ROWS[0][1], ROWS[1][1]],
        "negative": [ROWS[2][1], ROWS[3][1]],
        "top": [ROWS[i][1] for i in (0, 1, 2, 3, 5)],
    }
    for name, group in groups.items():
        docs = [Counter(w for w in t.split() if w not in stop and len(w) > 1) for t in group]
        df = Counter(w for d in docs for w in d)
        total = Counter()
        for d in docs:
            weights = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()}
            norm = math.sqrt(sum(v * v for v in weights.values()))
            for w, v in weights.items():
                total[w] += v / norm / len(docs)
        expected = sorted(((w, round(v, 6)) for w, v in total.items()), key=lambda p: (-p[1], p[0]))
        assert found[name] == expected


def test_vocabulary_cap(labelled):
    found = by_class(keywords.keyword_tfidf(keywords.distinct_texts(labelled), max_features=1), "word")
    assert found == {"positive": [("great",)], "negative": [("crash",)], "top": [("crash",)]}


def test_merge(labelled):
    texts = keywords.distinct_texts(labelled)
    tfidf = keywords.keyword_tfidf(texts)
    short_list = keywords.keyword_frequencies(texts, n=1)
    merged = {(r["class"], r.word): r["count"] for r in keywords.merge_keywords(tfidf, short_list).collect()}
    assert merged[("positive", "great")] == 3 and merged[("positive", "love")] == 0
    full = {
        (r["class"], r.word): r["count"]
        for r in keywords.merge_keywords(tfidf, keywords.word_frequencies(texts)).collect()
    }
    assert full[("positive", "love")] == 2


def test_no_labelled_texts(labelled):
    assert reports.keyword_report(labelled.where("false")).count() == 0
    lists = keywords.keyword_lists(reports.keyword_report(labelled.where("false"))).first()
    assert (lists.positive, lists.negative, lists.top) == ([], [], [])


def test_nested_json(spark, labelled, tmp_path):
    lists = keywords.keyword_lists(reports.keyword_report(labelled))
    tables.write_keyword_lists(lists, str(tmp_path / "kw"))
    stored = json.loads(next((tmp_path / "kw").glob("part-*.json")).read_text())
    assert [e["word"] for e in stored["positive"]][:1] == ["great"]
    assert set(stored["top"][0]) == {"word", "tfidf", "count"}
    back = tables.read_keyword_lists(spark, str(tmp_path / "kw"))
    assert back.collect() == lists.collect()
    assert keywords.keyword_rows(back).where("class = 'negative' and rank = 1").first().word == "crash"


def test_json_without_tfidf(spark, tmp_path):
    (tmp_path / "kw.json").write_text('{\n "positive": [{"word": "love",\n "count": 2}], "negative": [], "top": []}')
    row = tables.read_keyword_lists(spark, str(tmp_path / "kw.json")).first()
    assert (row.positive[0].word, row.positive[0].tfidf, row.positive[0]["count"]) == ("love", 0.0, 2)


def test_minimum_count(labelled):
    found = by_class(keywords.keyword_frequencies(keywords.distinct_texts(labelled), min_count=2), "word")
    assert found["positive"] == [("great",), ("love",)]


def test_source_choice(spark, labelled, mismatch_rows):
    first = tables.labelled_texts(labelled, mismatch_rows, spark)
    assert first.count() == len(ROWS)
    second = tables.labelled_texts(None, mismatch_rows, spark)
    assert second.where(F.col("review_id") == "0").first().clean_text == "met someone kind in week one thank you"
    assert tables.labelled_texts(None, None, spark).count() == 0
