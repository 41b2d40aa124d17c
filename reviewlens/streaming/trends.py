"""Trends over a stream of timed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(rows: DataFrame, time: str, positive: Column, negative: Column) -> DataFrame:
    """Positive and negative rows per day; works on batch and stream."""
    return (
        rows.groupBy(F.window(time, "1 day").alias("day"))
        .agg(F.count_if(positive).alias("positive"), F.count_if(negative).alias("negative"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "positive", "negative")
    )


def deduplicated(rows: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """Rows of an at-least-once source, each key once within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_daily_counts(
    rows: DataFrame, time: str, positive: Column, negative: Column, out: str, checkpoint: str, delay: str = "2 days"
) -> StreamingQuery:
    """Append each day once the watermark has passed it; process what is there and stop.

    Days still inside the watermark are not written yet and rows later than it are left out, as append mode
    has it; ``upsert_daily_counts`` has every row at once.
    """
    counts = daily_counts(rows.withWatermark(time, delay), time, positive, negative)
    return (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_daily_counts(
    rows: DataFrame, time: str, positive: Column, negative: Column, out: str, checkpoint: str
) -> StreamingQuery:
    """Keep per-batch partial counts; ``read_daily_counts`` adds them up, late rows included."""

    def handle(batch: DataFrame, number: int) -> None:
        daily_counts(batch, time, positive, negative).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_counts(partials: DataFrame) -> DataFrame:
    return partials.groupBy("date").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
