"""First row per key, ordinal ids, exact seeded samples and splits.

None of these sends a whole group to one task: keys are reduced with partial
aggregates, ranks are found from a histogram of hash buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.schemas import NEGATIVE, POSITIVE
from reviewlens.sources.scratch import materialise

# Hex digits of a digest that make a bucket: 65,536 buckets.
_BUCKET_DIGITS = 4


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` of every key; copies of a key collapse before the shuffle."""
    order = F.col(order) if isinstance(order, str) else order
    others = [c for c in df.columns if c not in keys]
    # The struct keeps rows whose order is null: they come first.
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(order)).alias("_row"))
    return kept.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows, or all of them."""
    return df if n is None else df.orderBy(order).limit(n)


def ordinal_ids(df: DataFrame, order: str, name: str, width: int = 1 << 20) -> DataFrame:
    """Number rows 0, 1, 2, … by a unique integer column.

    Rows are ranked inside ranges of ``width`` order values; the rows before each
    range come from one count per range. Rows whose order is null come first.
    """
    ranged = df.withColumn("_range", F.expr(f"floor({order} / {width})"))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (
        ranged.withColumn("_rank", inside)
        .join(offsets.withColumnRenamed("_range", "_of"), F.col("_range").eqNullSafe(F.col("_of")))
        .drop("_of")
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_range", "_rank", "_offset")
    )


def _hash_position(key: str, seed: int) -> Column:
    """Where a row stands in the order of MD5 digests of ``seed:key``, which any engine can repeat: bucket, digest, key."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    bucket = F.substring(digest, 1, _BUCKET_DIGITS)
    return F.struct(bucket.alias("bucket"), digest.alias("hash"), F.col(key).alias("key"))


def _hash_cutoffs(df: DataFrame, groups: Sequence[str], key: str, seed: int, quotas: DataFrame) -> DataFrame:
    """``(*groups, cutoff)``: per group the position of its ``quota``-th row in hash order.

    Counts per bucket find the bucket; only its rows are ranked. One row per group is
    written, so that later actions on the result do not rank again.
    """
    placed = df.select(*groups, _hash_position(key, seed).alias("_at")).withColumn("_bucket", F.col("_at.bucket"))
    counts = placed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket and group.
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum("_n").over(running))
    if groups:
        wanted = summed.join(F.broadcast(quotas), list(groups))
    else:
        wanted = summed.withColumn("quota", quotas.scalar())
    before = F.col("_upto") - F.col("_n")
    edges = wanted.where((F.col("_upto") >= F.col("quota")) & (before < F.col("quota"))).select(
        *groups, "_bucket", (F.col("quota") - before).alias("_need")
    )
    order = Window.partitionBy(*groups, "_bucket").orderBy("_at")
    ranked = placed.join(F.broadcast(edges), [*groups, "_bucket"]).withColumn("_rank", F.row_number().over(order))
    cutoffs = ranked.where(F.col("_rank") == F.col("_need")).select(*groups, F.col("_at").alias("cutoff"))
    return materialise(cutoffs, "cutoffs")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer), the same ones on every run."""
    quota = df.agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("quota"))
    cutoff = _hash_cutoffs(df, [], key, seed, quota).scalar()
    return df.where(_hash_position(key, seed) <= cutoff)


def split_quotas(df: DataFrame, label: str, test_share: float) -> DataFrame:
    """Test rows per label: proportional, rounded so that they add up to the whole test size."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy()
    exact = F.col("rows") * F.ceil(F.sum("rows").over(everything) * test_share) / F.sum("rows").over(everything)
    shares = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    missing = F.sum("_exact").over(everything) - F.sum("_floor").over(everything)
    by_remainder = F.row_number().over(
        Window.partitionBy().orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(label))
    )
    return shares.select(
        label,
        "rows",
        (F.col("_floor") + F.when(by_remainder <= F.round(missing), 1).otherwise(0)).cast("bigint").alias("quota"),
    )


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_share: float = 0.2,
    seed: int = 42,
    labels: Sequence[str] = (NEGATIVE, POSITIVE),
) -> DataFrame:
    """Mark an exact, repeatable stratified test set in a new column ``is_test``.

    Rows with another label are dropped; one quota row per listed label is broadcast.
    """
    df = df.where(F.col(label).isin(list(labels)))
    quotas = split_quotas(df, label, test_share).select(label, "quota")
    cutoffs = _hash_cutoffs(df, [label], key, seed, quotas)
    inside = F.coalesce(_hash_position(key, seed) <= F.col("cutoff"), F.lit(False))
    return df.join(F.broadcast(cutoffs), label, "left").withColumn("is_test", inside).drop("cutoff")
