"""Phrases from a table of any size, found as whole words by joins.

A text is cut into units, words and what stands between them; a phrase is a string of units that begins and ends with a
word. Only units that a bounded filter lets through as a phrase's first word are exploded, each with as many units as the
longest phrase has. They meet the phrases' lengths by first word, then the phrases themselves by their string. Plan and
filter are the same size for ten phrases and for ten million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import WORD
from reviewlens.operators.columns import with_computed
from reviewlens.sources.scratch import materialise

# Bits of the filter of first words; as an array of longs it is 8 KB of the plan.
_FILTER_BITS = 1 << 16


def units(text: Column) -> Column:
    """Lower-cased words and the runs between them, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+|[^{WORD}]+"), 0)


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(_FILTER_BITS)).cast("int")


def phrase_table(phrases: DataFrame, name: str = "name", phrase: str = "phrase") -> DataFrame:
    """``(name, phrase, first, size)``; null phrases are left out, one that does not begin and end with a word is an error."""
    cut = units(F.col(phrase))
    rows = phrases.where(F.col(phrase).isNotNull()).select(F.col(name).alias("name"), F.lower(phrase).alias("phrase"), cut.alias("_units"))
    word = f"^[{WORD}]"
    whole = F.col("phrase").rlike(word) & F.element_at("_units", -1).rlike(word)
    checked = F.when(whole, F.col("phrase")).otherwise(F.raise_error(F.concat(F.lit("no phrase of whole words: "), "phrase")).cast("string"))
    return rows.select("name", checked.alias("phrase"), F.element_at("_units", 1).alias("first"), F.size("_units").alias("size")).distinct()


def phrase_matches(texts: DataFrame, phrases: DataFrame, key: str = "review_id", text: str = "clean_text", longest: bool = False) -> DataFrame:
    """``(key, pos, size, name, phrase)``: every phrase at the unit where it starts, or the longest per start.

    ``phrases`` is from :func:`phrase_table`; a phrase may have several names. A null text has none.
    """
    phrases = materialise(phrases, "phrases")
    widest = phrases.agg(F.max("size")).first()[0] or 0
    # At most _FILTER_BITS numbers.
    set_bits = [row.slot for row in phrases.select(_slot(F.col("first")).alias("slot")).distinct().collect()]
    table = [0] * (_FILTER_BITS // 64)
    for slot in set_bits:
        table[slot // 64] |= 1 << slot % 64
    # Shorter in one expression than in a thousand; the lowest long has no literal of its own.
    longs = F.expr(f"array({', '.join(f'{x}L' if x < 1 << 63 else f'(-{(1 << 64) - 1 - x}L - 1L)' for x in table)})")

    def may_start(unit: Column) -> Column:
        slot = _slot(unit)
        return F.getbit(F.element_at(longs, F.floor(slot / 64).cast("int") + 1), slot % 64) == 1

    cut = with_computed(texts.select(key, F.col(text).alias("_text")), "_units", units(F.col("_text"))).drop("_text")
    placed = F.transform("_units", lambda unit, i: F.struct((i + 1).alias("pos"), unit.alias("first")))
    starts = F.filter(placed, lambda s: may_start(s["first"]))

    def window(s: Column) -> Column:
        # Element by element: a slice copies the whole text's units first.
        last = F.least(s["pos"] + (max(widest, 1) - 1), F.size("_units"))
        return F.struct(s["pos"], s["first"], F.transform(F.sequence(s["pos"], last), lambda i: F.element_at("_units", i)).alias("_window"))

    begun = with_computed(cut, "_starts", starts)
    windows = begun.select(key, F.inline(F.transform("_starts", window)))
    sizes = phrases.groupBy("first").agg(F.collect_set("size").alias("_sizes"))
    sized = windows.join(sizes, "first").select(key, "pos", "_window", F.explode("_sizes").alias("size"))
    named = sized.where(F.size("_window") >= F.col("size")).select(
        key, "pos", "size", F.array_join(F.slice("_window", F.lit(1), F.col("size")), "").alias("phrase")
    )
    found = named.join(phrases.select("name", "phrase"), "phrase").select(key, "pos", "size", "name", "phrase")
    if not longest:
        return found
    best = found.groupBy(key, "pos").agg(F.max("size").alias("size"))
    return found.join(best, [key, "pos", "size"]).select(key, "pos", "size", "name", "phrase")


def tagged(texts: DataFrame, phrases: DataFrame, key: str = "review_id", text: str = "clean_text", default: str = "General") -> DataFrame:
    """``(key, aspect)``: the names found in every text, ``default`` where there is none. ``key`` is unique."""
    names = phrase_matches(texts, phrases, key, text).select(key, F.col("name").alias("aspect")).distinct()
    return texts.select(key).join(names, key, "left").na.fill({"aspect": default})
