import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.operators.scoring import lexicon_scorer
from reviewlens.plans import reports
from reviewlens.schemas import MISMATCHES, RAW_REVIEWS
from reviewlens.sources import ingest, tables
from reviewlens.streaming import uploads


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def today():
    return F.lit("2025-06-30").cast("date")


def test_accepted_columns():
    assert ingest.resolve_columns(["Rating", "TEXT", "review_text", "At", "Source"]) == {
        "review_text": "TEXT",
        "star_rating": "Rating",
        "app_name": "Source",
        "review_date": "At",
    }
    assert ingest.resolve_columns(["content"])["star_rating"] is None
    with pytest.raises(ingest.MissingTextColumn):
        ingest.resolve_columns(["name", "rating"])


def test_upload(spark, tmp_path):
    path = write(
        tmp_path / "up.csv",
        'content [the text],Score,created_at,extra\n"Great, app",5,13/02/2025,x\nmeh,abc,2025-03-01,y\n,,never,z\n',
    )
    read = ingest.read_upload(spark, path, today())
    rows = {r.extra: r for r in read.rows.collect()}
    assert read.rows.columns == [
        "review_id", "review_text", "star_rating", "app_name", "review_date", "content", "Score", "created_at", "extra",
    ]
    assert (rows["x"].review_text, rows["x"].star_rating, rows["x"].review_date) == ("Great, app", 5.0, "2025-02-13")
    assert (rows["y"].star_rating, rows["y"].review_date, rows["y"].app_name) == (3.0, "2025-03-01", "Custom Dataset")
    assert (rows["z"].review_text, rows["z"].star_rating, rows["z"].review_date) == ("", 3.0, None)
    assert {k: r.review_id for k, r in rows.items()} == {"x": "0", "y": "1", "z": "2"}
    assert read.quarantine.count() == 0


def test_upload_without_dates_or_ratings(spark):
    df = spark.createDataFrame([(7, "b"), (2, "a")], "line long, Review string")
    rows = ingest.conform_upload(df, today(), order="line").orderBy("line").collect()
    assert [(r.review_id, r.review_text, r.star_rating, r.review_date) for r in rows] == [
        ("0", "a", 3.0, "2025-06-30"),
        ("1", "b", 3.0, "2025-06-30"),
    ]


def test_row_cap_is_optional(spark, tmp_path):
    path = write(tmp_path / "many.csv", "text\n" + "\n".join(f"row {i}" for i in range(50)))
    assert ingest.read_upload(spark, path).rows.count() == 50
    assert ingest.read_upload(spark, path, max_rows=20).rows.count() == 20


def test_quarantine(spark, tmp_path):
    path = write(tmp_path / "bad.csv", b"text,score\nfine,5\ntoo,many,fields\nbroken \xff\xfe bytes,1\n")
    read = ingest.read_csv(spark, path)
    assert [r.text for r in read.rows.collect()] == ["fine"]
    assert read.quarantine.count() == 2
    with pytest.raises(Exception):
        ingest.read_csv(spark, path, fail_fast=True).rows.collect()


def test_raw_reviews(spark, tmp_path):
    path = write(
        tmp_path / "raw.csv",
        'review_id,app_name,review_text,star_rating,review_date,thumbs_up\n007,amber,"two\nlines ""quoted""",4,2025-01-02 03:04:05,3\n8,cobalt,x,bad,bad,\n',
    )
    rows = ingest.read_raw_reviews(spark, path).orderBy("review_id").collect()
    assert ingest.read_raw_reviews(spark, path).schema == RAW_REVIEWS
    assert tuple(rows[0]) == ("007", "amber", 'two\nlines "quoted"', 4.0, dt.date(2025, 1, 2), 3)
    assert tuple(rows[1]) == ("8", "cobalt", "x", None, None, None)


def test_store_export(spark):
    a = spark.createDataFrame([("1", "hi", 5, "2025-01-01")], "reviewId string, content string, score int, at string")
    b = spark.createDataFrame([("2", "yo", 7)], "reviewId string, content string, thumbsUpCount int")
    table = ingest.conform_store_export(ingest.union_apps({"x": a, "y": b}))
    assert table.schema.simpleString() == RAW_REVIEWS.simpleString()
    rows = table.orderBy("review_id").collect()
    assert tuple(rows[0]) == ("1", "x", "hi", 5.0, dt.date(2025, 1, 1), None)
    assert tuple(rows[1]) == ("2", "y", "yo", None, None, 7)


def test_tables(spark, raw, tmp_path):
    root = str(tmp_path)
    tables.write_table(raw, root, "raw_reviews", partition_by="app_name")
    assert tables.read_table(spark, root, "raw_reviews").count() == 10
    tables.write_table(tables.empty_table(spark, "mismatches"), root, "mismatches")
    assert tables.read_table(spark, root, "mismatches").schema == MISMATCHES


def test_upload_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", 'text,rating\n"I love it,\nreally",1\nok,3\nok,3\n')
    write(folder / "b.csv", "text,rating\nterrible crash,5\n")
    schema = ingest.csv_schema(spark, str(folder / "a.csv"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        query = uploads.stream_uploads(spark, str(folder), schema, out, lexicon_scorer(), state, today())
        query.awaitTermination()
        return query

    query = run()
    assert uploads.progress(query) == {"job_id": str(query.id), "status": "completed", "current": 4, "error": None}
    columns = ["review_text", "sentiment_label", "is_mismatch", "is_spam"]
    scored = spark.read.parquet(f"{out}/scored")
    assert scored.select("review_id").distinct().count() == 4  # equal rows are rows of their own
    streamed = scored.select(columns)
    batch = uploads.score_upload(ingest.read_csv(spark, str(folder)).rows, lexicon_scorer(), today()).select(columns)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert {(r.is_mismatch, r.is_spam) for r in batch.collect()} == {(True, False), (False, True)}
    write(folder / "c.csv", "text,rating\nnew file,4\n")
    run()
    status = uploads.job_status(spark, out).orderBy("batch_id").collect()
    assert [(r.status, r.current, r.percent) for r in status] == [("completed", 4, 100), ("completed", 1, 100)]


def test_failed_upload_batch_is_reported(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", "text,rating\nok,3\n")
    schema = ingest.csv_schema(spark, str(folder / "a.csv"))

    def broken(df):
        raise ValueError("no model")

    query = uploads.stream_uploads(spark, str(folder), schema, str(tmp_path / "out"), broken, str(tmp_path / "state"), today())
    with pytest.raises(Exception, match="no model"):
        query.awaitTermination()
    status = uploads.job_status(spark, str(tmp_path / "out")).first()
    assert (status.status, status.current, status.percent) == ("failed", 0, None)


def test_dataset_swap(spark, tmp_path):
    df = spark.createDataFrame([("love this great app", "5"), ("awful crash", "1"), ("meh", "3")], "text string, rating string")
    scored = uploads.score_upload(df, lexicon_scorer(), today())
    uploads.apply_dataset(spark, scored, str(tmp_path), "upload-1")
    try:
        assert spark.table("raw_reviews").count() == 3
        assert {r.aspect for r in spark.table("aspect_results").collect()} == {"Overall"}
        assert spark.table("flagged_reviews").where("is_spam").first().flag_reason == "too_short"
        assert [e.word for e in spark.table("keywords").first().positive] == ["app", "great", "love"]
        assert tables.labelled_texts_from_catalog(spark).count() == 3
    finally:
        for name in reports.upload_tables(scored):
            spark.catalog.dropTempView(name)


def test_store_export_keeps_rows_without_an_app(spark, monkeypatch):
    from workload import registry

    columns = "review_id string, review_text string, star_rating double, review_date string, app_name string"
    rows = [("a", "x", 1.0, None, "src1"), ("b", "y", 2.0, None, "src3"), ("c", "z", 3.0, None, None)]
    monkeypatch.setattr(registry.views, "reviews", lambda spark, sf_dir: spark.createDataFrame(rows, columns))
    got = registry.QUERIES["store_export"](spark, "").collect()
    assert {(r.review_id, r.app_name, r.thumbs_up) for r in got} == {("a", "one", None), ("b", "two", 1), ("c", "two", None)}
