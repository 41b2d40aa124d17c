"""TF-IDF in relational form.

Vocabulary: the ``max_features`` terms with the largest total count (ties by term).
IDF: ``ln((1 + documents) / (1 + documents with the term)) + 1``. Documents are
scaled to length one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = 64
_PART_BYTES = 8 << 20  # text that one task counts


def term_counts(docs: DataFrame, key: str, words: Column, *keep: str) -> DataFrame:
    """``(key, *keep, term, tf)`` of ``docs``, which holds only the columns in use.

    The texts are shuffled once by ``key``; all later per-document steps stay in that
    partitioning, which has a part for every ``_PART_BYTES`` of text: counting a part takes
    some forty times its size in memory.
    """
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in docs.dtypes if kind == "string"]
    size = docs.agg(F.sum(sum(texts, F.lit(0).cast("long")))).first()[0] or 0
    default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark merges parts whose number is not given up to a size that is too much here.
    parts = max(-(-size // _PART_BYTES), min(default, size >> 20))
    return (
        (docs.repartition(parts, key) if parts > 1 else docs.repartition(key))
        .select(key, *keep, F.explode_outer(words).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(key, *keep, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_totals(counts: DataFrame, *groups: str) -> DataFrame:
    """``(*groups, term, total, df)`` from term counts."""
    return counts.groupBy(*groups, "term").agg(
        F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")
    )


def smoothed_idf(df: Column, documents: Column) -> Column:
    return F.ln((1 + documents) / (1 + df)) + 1


def vocabulary(totals: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of one corpus."""
    return totals.orderBy(F.desc("total"), F.asc("term")).limit(max_features)


def vocabulary_per_group(totals: DataFrame, max_features: int, *groups: str) -> DataFrame:
    """The most frequent terms of each group.

    Ranked in parts of a group first, so that no task sorts all terms of a group: the last ranking has at most
    ``_PARTS * max_features`` rows.
    """
    totals = totals.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(_PARTS)))
    for keys in ([*groups, "_part"], groups):
        order = Window.partitionBy(*keys).orderBy(F.desc("total"), F.asc("term"))
        totals = totals.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_features)
    return totals.drop("_rank", "_part")


def unit_vectors(weighted: DataFrame, key: str, entry: Column, *keep: str) -> DataFrame:
    """One row per document from rows with ``weight``: ``(key, *keep, entries, norm)``.

    ``entries`` is sorted; the number of entries of a document is bounded by the
    vocabulary.
    """
    return weighted.groupBy(key, *keep).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
