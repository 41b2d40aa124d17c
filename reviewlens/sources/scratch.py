"""Intermediate tables in the shared checkpoint folder."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from reviewlens.session import scratch_path

_WRITTEN: dict[str, list[str]] = {}
# Tables remembered by application and name.
KEPT: dict[tuple[str, str], DataFrame] = {}
# Spark's setting for shuffle files that go when their query ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# What the outcome being built has written on the way.
_STEPS: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, until :func:`release`."""
    path = scratch_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    steps = _STEPS.get()
    if steps is not None:
        steps.append(path)
    return path


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside delete their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table and read it back: later steps restart from it when executors are lost.

    Shuffle files of the write are deleted when it is done.
    """
    path = fresh_folder(df.sparkSession, name)
    with _shuffles_deleted(df.sparkSession):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _built(build: Callable[[], DataFrame], steps: list[str] | None) -> DataFrame:
    before = _STEPS.set(steps)
    try:
        return build()
    finally:
        _STEPS.reset(before)


def outcome(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write the table that ``build`` returns and read it back; what ``build`` wrote on the way is deleted."""
    steps: list[str] = []
    kept = materialise(_built(build, steps), name)
    written = _WRITTEN.get(kept.sparkSession.sparkContext.applicationId, [])
    for path in steps:
        if path in written:
            written.remove(path)
            delete_folder(kept.sparkSession, path)
    return kept


def remembered(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once per application and name, until :func:`release`."""
    key = (spark.sparkContext.applicationId, name)
    if key not in KEPT:
        # Of no outcome's steps, whoever asks first.
        KEPT[key] = _built(lambda: materialise(build(), "kept"), None)
    return KEPT[key]


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    folders = {file.rsplit("/", 2)[1] for file in df.inputFiles()}
    for path in [path for path in written if path.rsplit("/", 1)[1] in folders]:
        written.remove(path)
        delete_folder(spark, path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written so far; results that still read them must be done.

    Returns how many were deleted.
    """
    for key in [key for key in KEPT if key[0] == spark.sparkContext.applicationId]:
        del KEPT[key]
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_folder(spark, path)
    return len(paths)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if there is one, in whatever file system its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
