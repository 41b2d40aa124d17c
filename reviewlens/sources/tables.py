"""Analysis tables: Parquet with fixed schemas, and data sets that can be swapped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.text import clean_for_keywords
from reviewlens.operators.columns import with_computed
from reviewlens.schemas import KEYWORD_LISTS, TABLES
from reviewlens.sources.ingest import conform


def write_table(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> str:
    """Replace a table; an empty one keeps its schema. Raw reviews go well with ``app_name``."""
    path = f"{root.rstrip('/')}/{name}"
    table = conform(df, TABLES[name]) if name in TABLES else df
    writer = table.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{root.rstrip('/')}/{name}")


def write_keyword_lists(lists: DataFrame, path: str) -> None:
    """The nested keyword row as JSON; it is one row of at most three times fifty words."""
    lists.write.mode("overwrite").json(path)


def read_keyword_lists(spark: SparkSession, path: str) -> DataFrame:
    lists = spark.read.schema(KEYWORD_LISTS).option("multiLine", True).json(path)

    def complete(e):
        return F.struct(
            e["word"].alias("word"),
            F.coalesce(e["tfidf"], F.lit(0.0)).alias("tfidf"),
            e["count"].alias("count"),
        )

    return lists.select(*[F.transform(f.name, complete).alias(f.name) for f in KEYWORD_LISTS])


def labelled_texts(aspect_results: DataFrame | None, mismatches: DataFrame | None, spark: SparkSession) -> DataFrame:
    """``(review_id, clean_text, sentiment)`` from the aspect table, else from the
    mismatch table cleaned on the fly, else an empty table."""
    if aspect_results is not None:
        text = "clean_text" if "clean_text" in aspect_results.columns else "review_text"
        return aspect_results.select("review_id", F.col(text).alias("clean_text"), "sentiment")
    if mismatches is not None:
        cleaned = with_computed(mismatches, "clean_text", clean_for_keywords(F.col("review_text")))
        return cleaned.select("review_id", "clean_text", F.col("sentiment_label").alias("sentiment"))
    return spark.createDataFrame([], "review_id string, clean_text string, sentiment string")


def labelled_texts_from_catalog(spark: SparkSession) -> DataFrame:
    """The same choice over the tables and views the session knows."""

    def table(name: str) -> DataFrame | None:
        return spark.table(name) if spark.catalog.tableExists(name) else None

    return labelled_texts(table("aspect_results"), table("mismatches"), spark)


def publish_dataset(tables: Mapping[str, DataFrame], root: str, dataset_id: str) -> None:
    """Write all tables of a data set next to those already there."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{dataset_id}", name)


def serve_dataset(spark: SparkSession, root: str, dataset_id: str, names: list[str]) -> None:
    """Point the session's views at a published data set."""
    for name in names:
        read_table(spark, f"{root.rstrip('/')}/{dataset_id}", name).createOrReplaceTempView(name)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


