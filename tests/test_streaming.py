import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.operators.scoring import lexicon_scorer
from reviewlens.sources import ingest
from reviewlens.streaming import trends, uploads


def at(day, hour):
    return dt.datetime(2025, 1, day, hour)


def events(spark, tmp_path, rows, name):
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, "id long, ts timestamp, kind string").write.mode("append").parquet(folder)
    return spark.readStream.schema("id long, ts timestamp, kind string").parquet(folder)


def sides():
    return F.col("kind") == "good", F.col("kind") == "bad"


def test_partial_counts_add_up(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    first = [(1, at(1, 5), "good"), (2, at(1, 6), "bad"), (3, at(2, 1), "good"), (4, at(2, 2), "other")]
    late = [(5, at(1, 7), "good"), (6, at(9, 1), "bad")]
    for rows in (first, late):
        stream = events(spark, tmp_path, rows, "e")
        trends.upsert_daily_counts(stream, "ts", *sides(), out, state).awaitTermination()
    found = trends.read_daily_counts(spark.read.parquet(out)).orderBy("date").collect()
    assert [tuple(r) for r in found] == [("2025-01-01", 2, 1), ("2025-01-02", 1, 0), ("2025-01-09", 0, 1)]
    batch = trends.daily_counts(spark.read.parquet(str(tmp_path / "events")), "ts", *sides())
    assert sorted(batch.collect()) == sorted(found)


def test_watermarked_days_are_appended_once(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in ([(1, at(1, 5), "good"), (2, at(8, 1), "bad")], [(3, at(1, 6), "good"), (4, at(20, 1), "bad")]):
        stream = events(spark, tmp_path, rows, "e")
        trends.write_daily_counts(stream, "ts", *sides(), out, state).awaitTermination()
    found = {r.date: (r.positive, r.negative) for r in spark.read.parquet(out).collect()}
    # Row 3 came after its day was closed; day 20 is still open.
    assert found == {"2025-01-01": (1, 0), "2025-01-08": (0, 1)}


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = [(1, at(1, 5), "good"), (1, at(1, 6), "good"), (2, at(1, 7), "bad")]
    stream = trends.deduplicated(events(spark, tmp_path, rows, "e"), "id", "ts")
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def upload_of(spark, tmp_path, scorer, **options):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / "a.csv").write_text("text,rating\n" + "".join(f"fine number {i},{i % 5 + 1}\n" for i in range(40)) + "a,b,c\n")
    schema = ingest.csv_schema(spark, str(folder / "a.csv"))
    return uploads.stream_uploads(spark, str(folder), schema, str(tmp_path / "out"), scorer, str(tmp_path / "state"), **options)


def test_percent_rises_inside_a_batch(spark, tmp_path):
    seen = []

    def watched(df):
        status = uploads.job_status(spark, str(tmp_path / "out")).first()
        seen.append((status.status, status.current, status.total, status.percent, status.quarantined))
        return lexicon_scorer()(df)

    query = upload_of(spark, tmp_path, watched, slices=4)
    query.awaitTermination()
    assert len(seen) == 4 and {s[0] for s in seen} == {"processing"} and {(s[2], s[4]) for s in seen} == {(40, 1)}
    assert [s[1] for s in seen] == sorted(s[1] for s in seen) and seen[0][3] == 0
    assert 0 < seen[2][3] < 100
    last = uploads.job_status(spark, str(tmp_path / "out")).collect()
    assert [tuple(r) for r in last] == [(0, "completed", 40, 40, 100, 1)]
    scored = spark.read.parquet(str(tmp_path / "out/scored"))
    assert scored.count() == scored.select("review_id").distinct().count() == 40


def test_a_batch_tried_again_replaces_its_slices(spark, tmp_path):
    calls = []

    def fails_late(df):
        calls.append(1)
        if len(calls) == 3:
            raise ValueError("lost")
        return lexicon_scorer()(df)

    query = upload_of(spark, tmp_path, fails_late, slices=4)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    status = uploads.job_status(spark, str(tmp_path / "out")).first()
    assert status.status == "failed" and status.percent is None
    assert status.current == spark.read.parquet(str(tmp_path / "out/scored")).count() < 40
    upload_of(spark, tmp_path, lexicon_scorer(), slices=2).awaitTermination()
    status = uploads.job_status(spark, str(tmp_path / "out")).first()
    assert (status.status, status.current, status.percent) == ("completed", 40, 100)
    scored = spark.read.parquet(str(tmp_path / "out/scored"))
    assert scored.count() == scored.select("review_id").distinct().count() == 40
