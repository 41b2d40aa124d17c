"""Mixing sources to target weights by repetition rates.

Words are totalled per source, targets follow from the weights, and every document is emitted
``floor(rate)`` times plus one Bernoulli copy whose draw comes from a hash of its id and text, so that rows of one id
draw apart. Of a few seeds, each source uses the one whose copies come nearest to its target; draws stay hashes, so
reruns agree. Choosing among seeds moves the probability of a copy a little from the fraction, towards what the
target needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.names import null_safe_key, unused, words
from reviewlens.sources.scratch import materialise

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# Draws of 32 bits that one SHA-256 digest holds.
_SEEDS = 8


def document_sizes(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.size(words(text)).cast("long")


def _identity(doc_id: Column, text: Column) -> Column:
    """Digest that the draws of a document come from."""
    named = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.sha2(named, 256)


def _draw(digest: Column, seed: int) -> Column:
    return F.conv(F.substring(digest, 8 * seed + 1, 8), 16, 10).cast("double") / 2.0**32


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to ``(key, source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn and share all words. No target exceeds
    ``most`` times the source's size: what a source cannot take goes to the others by weight. The fixed
    point has a closed form: in order of ``cap / weight`` the first sources are at their cap, and the rest
    share what is left. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighted = weighted.withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighted.withColumn("level", left / sharing)
    # The first source below its cap fixes the level for all after it.
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level["level"] * F.col("weight"), F.col("cap").cast("double")))
    return levelled.select("key", "source", "source_size", target.alias("target"))


def _copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def repetitions(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
) -> tuple[DataFrame, DataFrame]:
    """``(sizes, sources)``: one row per document, and one per source with its rate and chosen seed."""
    sizes = df.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        null_safe_key(F.col(source)).alias("key"),
        document_sizes(F.col(text)).alias("size"),
        _identity(F.col(doc_id), F.col(text)).alias("digest"),
    )
    sizes = materialise(sizes, "sizes")
    totals = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = materialise(source_targets(totals, weights, most).withColumn("rate", rate), "targets")
    # What each seed would take, as exact sums; partial aggregates keep a hot source off any one task.
    placed = sizes.join(sources.select("key", "rate"), "key")
    taken = [F.sum(F.col("size") * _copies(F.col("rate"), _draw(F.col("digest"), i))) for i in range(_SEEDS)]
    tried = materialise(placed.groupBy("key").agg(*[t.alias(f"taken_{i}") for i, t in enumerate(taken)]), "tried")
    chosen = sources.join(tried, "key")
    gaps = [F.struct(F.abs(F.col(f"taken_{i}") - F.col("target")).alias("gap"), F.lit(i).alias("seed")) for i in range(_SEEDS)]
    chosen = chosen.withColumn("seed", F.array_min(F.array(*gaps))["seed"])
    return sizes, materialise(chosen.select("key", "source_size", "target", "rate", "seed"), "rates")


def _chosen_copies(digest: Column) -> Column:
    draws = F.array(*[_draw(digest, i) for i in range(_SEEDS)])
    return _copies(F.col("rate"), F.element_at(draws, (F.col("seed") + 1).cast("int")))


def mixture_plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)``, one row per row of ``df``.

    Null texts have size 0; null sources are one source, the last. A source without words has target 0 and
    no copies. Repeated rows are separate documents, but rows equal in id and text draw alike. Other columns are not read.
    """
    sizes, sources = repetitions(df, doc_id, text, source, **options)
    planned = sizes.join(sources, "key").withColumn("copies", _chosen_copies(F.col("digest")).cast("long"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", "copies", taken)


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all columns.

    Nulls, repeated rows and empty tables as in :func:`mixture_plan`; columns may have any names.
    """
    _, sources = repetitions(df, doc_id, text, source, **options)
    key, copy = unused(df, "mix_key"), unused(df, "mix_copy")
    rates = sources.select(F.col("key").alias(key), F.struct("rate", "seed").alias(copy))
    keyed = df.withColumn(key, null_safe_key(F.col(source))).join(rates, key)
    digest = _identity(F.col(doc_id), F.col(text))
    draws = F.array(*[_draw(digest, i) for i in range(_SEEDS)])
    copies = _copies(F.col(copy)["rate"], F.element_at(draws, (F.col(copy)["seed"] + 1).cast("int")))
    times = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))
    return keyed.withColumn(copy, F.explode(times)).select(*[F.col(f"`{c}`") for c in df.columns])


def mixture_sql() -> str:
    """``mixture_plan`` over ``documents`` in SQL, without its ``copies``."""
    draw = "('0x' || substr(digest, {}, 8))::bigint / 4294967296.0::double"
    copies = "floor(rate) + case when {} < rate - floor(rate) then 1 else 0 end"
    tried = ", ".join(f"sum(size * ({copies.format(draw.format(8 * i + 1))})) as t{i}" for i in range(_SEEDS))
    gaps = ", ".join(f"struct_pack(gap := abs(t{i} - target), seed := {i})" for i in range(_SEEDS))
    picked = " ".join(f"when {i} then {draw.format(8 * i + 1)}" for i in range(_SEEDS))
    weight = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
    return rf"""
        with sizes as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                sha256(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as digest from documents),
        totals as (select source, sum(size)::bigint as source_size from sizes group by source),
        weighted as (
            select *, {MOST_REPEATS} * source_size as cap,
                case (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} {weight} end as weight from totals),
        levelled as (
            select *, (sum(source_size) over () - coalesce(sum(cap) over w, 0))::double
                / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
            from weighted
            window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
        fixed as (select arg_min(level, cap / weight) as level from levelled where level * weight <= cap),
        targets as (
            select source, source_size, least(cap::double, coalesce(fixed.level * weight, cap)) as target
            from levelled, fixed),
        rates as (select *, case when source_size > 0 then target / source_size else 0 end as rate from targets),
        tried as (
            select r.source, any_value(target) as target, {tried}
            from sizes s join rates r on s.source is not distinct from r.source group by r.source),
        seeds as (select source, list_min([{gaps}]).seed as seed from tried)
        select doc_id, size::bigint as size, source_size, target,
            (size * (floor(rate) + case when case seed {picked} end < rate - floor(rate) then 1 else 0 end))::bigint as taken
        from sizes s join rates r on s.source is not distinct from r.source
            join seeds e on s.source is not distinct from e.source"""
