"""Data sets of several tables that change as one: versioned manifests in a folder.

A manifest is a small JSON file that names the folders of every table of a version. Tables are written first, to folders
of their own; the version exists from the moment its manifest is renamed into place. A reader resolves the manifest
once and then reads fixed paths, so it sees a whole old or a whole new set, whatever is published meanwhile. Old
versions stay readable until they are released.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reviewlens.schemas import TABLES
from reviewlens.sources.ingest import conform

_MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Dataset:
    """One version: paths below ``root`` by table."""

    spark: SparkSession
    root: str
    version: int
    tables: Mapping[str, Sequence[str]]

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(TABLES[name]) if name in TABLES else self.spark.read
        return reader.parquet(*[f"{self.root}/{path}" for path in self.tables[name]])


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, conf = _hadoop(spark)
    folder = fs.Path(f"{root}/{_MANIFESTS}")
    system = folder.getFileSystem(conf)
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(name.split(".")[0]) for name in names if name.endswith(".json"))


def dataset(spark: SparkSession, root: str, version: int | None = None) -> Dataset | None:
    """A published version, the latest unless one is named; none in an empty folder."""
    root = root.rstrip("/")
    number = max(_versions(spark, root), default=None) if version is None else version
    if number is None:
        return None
    text = "".join(r.value for r in spark.read.text(f"{root}/{_MANIFESTS}/{number:012d}.json", wholetext=True).collect())
    return Dataset(spark, root, number, json.loads(text))


def commit(spark: SparkSession, root: str, tables: Mapping[str, Sequence[str]]) -> int:
    """Make folders below ``root`` the next version. Of two that commit at once one takes the number after the other's."""
    root = root.rstrip("/")
    fs, conf = _hadoop(spark)
    gateway = spark.sparkContext._gateway
    written = fs.Path(f"{root}/{_MANIFESTS}/{uuid.uuid4().hex}.tmp")
    system = written.getFileSystem(conf)
    out = system.create(written, False)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    context = fs.FileContext.getFileContext(written.toUri() if written.toUri().getScheme() else system.getUri(), conf)
    plain = gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        number = max(_versions(spark, root), default=0) + 1
        target = fs.Path(f"{root}/{_MANIFESTS}/{number:012d}.json")
        try:
            context.rename(system.makeQualified(written), system.makeQualified(target), plain)
        except Exception:
            if not system.exists(target):  # another one's commit is tried again behind it; anything else is an error
                raise
            continue
        return number


def publish(tables: Mapping[str, DataFrame], root: str, label: str = "set") -> int:
    """Write tables to fresh folders and make them the next version; returns its number.

    Known tables take their schemas. When a table fails, the version before stays.
    """
    root, folder = root.rstrip("/"), f"{label}-{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        (conform(df, TABLES[name]) if name in TABLES else df).write.parquet(f"{root}/{folder}/{name}")
    return commit(spark, root, {name: [f"{folder}/{name}"] for name in tables})


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """Make an older version's tables the next version."""
    return commit(spark, root, dataset(spark, root, version).tables)


def serve(found: Dataset) -> None:
    """Point the session's views at a version."""
    for name in found.tables:
        found.read(name).createOrReplaceTempView(name)


def release_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` newest versions, manifests first, and the folders that no kept one names."""
    root = root.rstrip("/")
    fs, conf = _hadoop(spark)
    numbers = _versions(spark, root)
    old, kept = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
    used = {path for number in kept for paths in dataset(spark, root, number).tables.values() for path in paths}
    unused = {path for number in old for paths in dataset(spark, root, number).tables.values() for path in paths} - used
    for name in [*(f"{_MANIFESTS}/{number:012d}.json" for number in old), *sorted(unused)]:
        path = fs.Path(f"{root}/{name}")
        path.getFileSystem(conf).delete(path, True)
    return old
