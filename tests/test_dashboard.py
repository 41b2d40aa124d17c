import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import aspects as aspect_ops
from reviewlens.plans import dashboard, insights


@pytest.fixture(scope="module")
def enriched(raw, mismatch_rows, flagged):
    return dashboard.enriched_reviews(raw, mismatch_rows, flagged, keep_opinions=False).cache()


def test_summary(raw, aspect_table, flagged, mismatch_rows):
    row = dashboard.summary(raw, aspect_table, flagged, mismatch_rows).first().asDict()
    assert row == {
        "total_reviews": 10,
        "avg_rating": 2.9,
        "positive_pct": 50.0,
        "negative_pct": 50.0,
        "spam_count_raw": 1,
        "mismatch_count": 1,
        "positive_share": 50,
        "has_anomalies": True,
    }


def test_summary_of_nothing(raw, aspect_table, flagged, mismatch_rows):
    none = [df.where("false") for df in (raw, aspect_table, flagged, mismatch_rows)]
    row = dashboard.summary(*none).first()
    assert (row.total_reviews, row.positive_pct, row.spam_count_raw, row.has_anomalies) == (0, 0.0, 0, False)


def test_trends(enriched):
    rows = dashboard.daily_trends(enriched).collect()
    assert [r.date for r in rows] == [f"2025-01-{d:02d}" for d in range(1, 11)]
    assert (rows[9].positive, rows[9].negative) == (1, 0)


def test_mismatch_list(mismatch_rows):
    assert [r.review_id for r in dashboard.mismatch_list(mismatch_rows).collect()] == ["9"]


@pytest.mark.parametrize(
    "filters, ids",
    [
        ({}, "0123456789"),
        ({"sentiment": "Negative"}, "1467"),
        ({"min_stars": 4}, "0358"),
        ({"max_stars": 2}, "14679"),
        ({"min_stars": 2, "max_stars": 3}, "27"),
        ({"is_mismatch": True}, "9"),
        ({"is_spam": True, "sentiment": "Positive"}, "9"),
        ({"is_spam": False, "max_stars": 1}, "146"),
    ],
)
def test_filters(enriched, filters, ids):
    matching = dashboard.matching_reviews(enriched, **filters)
    assert sorted(r.review_id for r in matching.select("review_id").collect()) == list(ids)
    assert dashboard.reviews_total(matching).first().total == len(ids)


def test_pages_add_up(enriched):
    pages = [dashboard.reviews_page(enriched, "seq", page, 3).collect() for page in range(1, 6)]
    assert [len(p) for p in pages] == [3, 3, 3, 1, 0]
    assert [r.review_id for p in pages for r in p] == [str(i) for i in range(10)]
    assert pages[0][0].total == 10
    assert dashboard.reviews_total(enriched, 3).first().pages == 4


def test_keyset_pages_equal_offset_pages(enriched):
    by_offset = [r.review_id for r in dashboard.reviews_page(enriched, "seq", 2, 4).collect()]
    by_key = [r.review_id for r in dashboard.reviews_after(enriched, "seq", 3, 4).collect()]
    assert by_key == by_offset


@pytest.mark.parametrize("page, size", [(0, 20), (1, 0), (1, 101)])
def test_page_bounds(enriched, page, size):
    with pytest.raises(ValueError):
        dashboard.reviews_page(enriched, "seq", page, size)


def test_enriched_keeps_duplicates_of_the_raw_table_only(raw, mismatch_rows, flagged):
    doubled = dashboard.enriched_reviews(raw.union(raw), mismatch_rows.union(mismatch_rows), flagged.union(flagged))
    assert doubled.count() == 20


def test_enriched_without_scores(raw, mismatch_rows, flagged):
    rows = dashboard.enriched_reviews(raw, mismatch_rows.where("false"), flagged.where("false")).collect()
    assert all(r.sentiment_label is None and r.is_mismatch is False and r.is_spam is False for r in rows)


def test_short_opinion_is_no_spam(raw, mismatch_rows, spark):
    everything = raw.select("review_id", F.lit(True).alias("is_spam"))
    rows = dashboard.enriched_reviews(raw, mismatch_rows, everything).where("not is_spam").collect()
    assert sorted(r.review_id for r in rows) == ["3", "4", "5", "6"]


def test_aspects(aspect_table):
    rows = {r.name: r for r in aspect_ops.aspect_summary(aspect_table).collect()}
    assert list(rows) == sorted(rows)
    assert all(r.total == r.positive + r.negative for r in rows.values())
    assert (rows["Bugs"].negative, rows["Matches"].positive, rows["Bugs"].negative_share) == (2, 2, 100)
    assert sum(r.total for r in rows.values()) == 10
    cross = {r.aspect: r for r in aspect_ops.aspect_crosstab(aspect_table).collect()}
    assert (cross["Safety"].Positive, cross["Safety"].Negative) == (0, 1)


def test_compare(raw, aspect_table):
    rows = dashboard.compare_apps(raw, aspect_table).collect()
    assert [(r.app_name, r.total_reviews, r.avg_rating, r.positive_pct) for r in rows] == [
        ("amber", 5, 3.0, 60.0),
        ("cobalt", 5, 2.8, 40.0),
    ]


def test_compare_app_without_sentiment(raw, aspect_table):
    rows = dashboard.compare_apps(raw, aspect_table.where("app_name = 'cobalt'")).collect()
    assert (rows[0].app_name, rows[0].positive_pct, rows[0].negative_pct) == ("amber", 0.0, 0.0)


def test_null_app_counts_in_summary_only(raw, aspect_table, flagged, mismatch_rows):
    unnamed = raw.withColumn("app_name", F.when(F.col("seq") > 0, F.col("app_name")))
    assert sum(r.total_reviews for r in dashboard.compare_apps(unnamed, aspect_table).collect()) == 9
    assert dashboard.summary(unnamed, aspect_table, flagged, mismatch_rows).first().total_reviews == 10


def test_insights(spark, enriched, aspect_table):
    month = insights.monthly_trends(enriched).first()
    assert (month.month, month.reviews, month.positive, month.change) == (dt.date(2025, 1, 1), 10, 6, None)
    trends = dashboard.daily_trends(enriched)
    releases = spark.createDataFrame([("2025-01-03", "1.1"), ("2025-01-08", "1.2")], "released string, version string")
    marks = [r.release for r in insights.trends_with_releases(trends, releases).orderBy("date").collect()]
    assert marks == [None] * 2 + ["1.1"] * 5 + ["1.2"] * 3
    assert insights.last_days(enriched, 3).count() == 3
    cube = insights.app_aspect_matrix(aspect_table).where("app_name is null and aspect is null").first()
    assert (cube.positive, cube.negative) == (5, 5)
    assert insights.search_reviews(enriched, "OVERpriced").count() == 1
    assert [r.review_id for r in insights.anomalies(enriched, kind="low_rating_positive").collect()] == ["9"]
    top = insights.dominant_sentiment(aspect_ops.aspect_summary(aspect_table)).where("name = 'Bugs'").first()
    assert (top.dominant, top.fill_pct) == ("Negative", 100.0)
