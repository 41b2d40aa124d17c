"""Result tables in buckets of their review id, so that views join them without a shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(root: str, name: str) -> str:
    """The catalog's name for a table below ``root``."""
    return f"{name}_{hashlib.md5(root.rstrip('/').encode()).hexdigest()}"


def write_bucketed(tables: Mapping[str, DataFrame], root: str, buckets: int, key: str = "review_id") -> None:
    """Write tables below ``root`` in ``buckets`` files each, by hash of ``key`` and sorted by it.

    Each table is shuffled once, here. Tables of the same names and root are replaced. A key that many rows share fills
    its bucket: use it for keys with few rows each. Null keys lie in one bucket.
    """
    for name, df in tables.items():
        spark = df.sparkSession
        spark.sql(f"drop table if exists {_table(root, name)}")
        # Placed as the buckets are, so that every task writes one file.
        placed = df.repartition(buckets, F.col(key))
        writer = placed.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        writer.option("path", f"{root.rstrip('/')}/{name}").saveAsTable(_table(root, name))


def read_bucketed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as the session's catalog knows it; the catalog is what holds the buckets."""
    return spark.table(_table(root, name))


def forget_bucketed(spark: SparkSession, root: str, names: list[str]) -> None:
    """Take tables out of the catalog; their files stay until :func:`reviewlens.sources.scratch.release` or the owner deletes them."""
    for name in names:
        spark.sql(f"drop table if exists {_table(root, name)}")
