"""Uploads as incremental ingest: one scoring function for batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reviewlens.functions.rules import is_mismatch, is_upload_spam
from reviewlens.operators.scoring import Scorer
from reviewlens.plans.reports import upload_tables
from reviewlens.sources.datasets import dataset, publish, serve
from reviewlens.sources.ingest import conform_upload, csv_rows
from reviewlens.sources.records import FILE, OFFSET, file_lines
from reviewlens.sources.scratch import delete_folder, materialise

_STATUS = "batch_id bigint, status string, current bigint, total bigint, quarantined bigint, at timestamp"

# Rows scored by batch, of the runs that this process has begun.
_ROWS: dict[tuple[str, str], dict[int, int]] = {}


def score_upload(rows: DataFrame, scorer: Scorer, today: Column | None = None, order: str | None = None) -> DataFrame:
    """Conformed upload rows with label, score and both flags."""
    scored = scorer(conform_upload(rows, today, order))
    stars, text = F.col("star_rating"), F.col("review_text")
    return scored.withColumns(
        {
            "is_mismatch": is_mismatch(stars, F.col("sentiment_label")),
            "is_spam": is_upload_spam(text, stars),
        }
    )


def job_id(query_id: str, batch: int) -> str:
    return f"{query_id}-{batch}"


def stream_uploads(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    out: str,
    scorer: Scorer,
    checkpoint: str,
    today: Column | None = None,
    slices: int = 8,
) -> StreamingQuery:
    """Score every CSV that appears in ``folder``; process what is there and stop.

    Results go to ``out/scored/batch=N``, records that cannot be read to ``out/quarantine/batch=N`` with file, byte offset
    and reason. A batch is read and written once, which observes how many rows it has, then scored in ``slices`` by hash of
    the place of a record; ``out/job_status`` gets a row when a batch begins, is read, after every slice and at its end
    (processing, then completed or failed), see :func:`job_status`. A batch that is tried again replaces its own folders.
    Ids are the batch, the file and the place in it, so equal rows differ.
    """
    source = file_lines(spark, folder, stream=True)
    counts: dict[int, int] = {}

    def report(number: int, status: str, current: int, total: int | None, quarantined: int | None = None) -> None:
        row = {"batch_id": number, "status": status, "current": current, "total": total, "quarantined": quarantined}
        kinds = dict(field.split(" ") for field in _STATUS.split(", "))
        made = spark.range(1).select(*[F.lit(value).cast(kinds[name]).alias(name) for name, value in row.items()])
        # Rows are only added, so that a reader never finds the table half replaced.
        made.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{out}/job_status")

    def handle(batch: DataFrame, number: int) -> None:
        target = f"{out}/scored/batch={number}"
        counts[number] = 0
        report(number, "processing", 0, None)
        try:
            read = csv_rows(batch, schema)
            all_rows, bad_rows = Observation("rows"), Observation("quarantine")
            bad = read.quarantine.observe(bad_rows, F.count(F.lit(1)).alias("n"))
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
            placed = read.rows.observe(all_rows, F.count(F.lit(1)).alias("n"))
            placed = placed.withColumn("_slice", F.pmod(F.xxhash64(FILE, OFFSET), F.lit(slices)).cast("int"))
            parsed = materialise(placed, "parsed", "_slice")
            total, quarantined = all_rows.get.get("n", 0), bad_rows.get.get("n", 0)
            report(number, "processing", 0, total, quarantined)
            delete_folder(spark, target)
            place = F.concat_ws("-", F.lit(number), F.xxhash64(FILE), F.col(OFFSET))
            for part in range(slices):
                done = Observation("scored")
                scored = score_upload(parsed.where(F.col("_slice") == part).drop("_slice"), scorer, today)
                scored = scored.withColumn("review_id", place).drop(FILE, OFFSET).observe(done, F.count(F.lit(1)).alias("n"))
                scored.write.parquet(f"{target}/slice={part}")
                counts[number] += done.get.get("n", 0)
                report(number, "processing", counts[number], total, quarantined)
        except Exception:
            report(number, "failed", counts[number], None)
            raise
        report(number, "completed", counts[number], total, quarantined)

    query = (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    _ROWS[str(query.id), str(query.runId)] = counts
    return query


def job_status(spark: SparkSession, out: str) -> DataFrame:
    """``(batch_id, status, current, total, percent, quarantined)``: the last report of each batch begun.

    ``total`` and ``quarantined`` are null until a batch is read, and once it has failed.
    """
    reports = spark.read.schema(_STATUS).parquet(f"{out}/job_status")
    values = ("status", "current", "total", "quarantined")
    last = reports.groupBy("batch_id").agg(F.max_by(F.struct(*values), "at").alias("last"))
    percent = F.floor(F.try_divide(F.col("last.current") * 100, F.col("last.total"))).alias("percent")
    return last.select("batch_id", "last.status", "last.current", "last.total", percent, "last.quarantined")


def progress(query: StreamingQuery) -> dict[str, object]:
    """State of a running upload: processing, completed or failed, and rows so far."""
    error = query.exception()
    state = "failed" if error else ("processing" if query.isActive else "completed")
    counts = _ROWS.get((str(query.id), str(query.runId)))
    rows = sum(p["numInputRows"] for p in query.recentProgress) if counts is None else sum(counts.values())
    return {"job_id": str(query.id), "status": state, "current": rows, "error": str(error) if error else None}


def apply_dataset(
    spark: SparkSession,
    scored: DataFrame,
    root: str,
    dataset_id: str,
    tables: Callable[[DataFrame], dict[str, DataFrame]] = upload_tables,
) -> None:
    """Publish the tables of an upload, scored once, as one version and point the session's views at it."""
    version = publish(tables(materialise(scored, "scored")), root, dataset_id)
    serve(dataset(spark, root, version))
