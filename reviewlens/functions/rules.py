"""Business rules as column functions. Every flag is true or false, never null."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import ASPECTS
from reviewlens.functions.text import SPACE, WORD, bound, tokens, word_count
from reviewlens.schemas import NEGATIVE, POSITIVE


def known(flag: Column) -> Column:
    """A flag with null read as false."""
    return F.coalesce(flag, F.lit(False))


def weak_label(rating: Column) -> Column:
    """Label implied by the stars; null for three stars or an unreadable rating."""
    stars = rating.cast("string").try_cast("double")
    return F.when(stars <= 2, F.lit(NEGATIVE)).when((stars >= 4) & ~F.isnan(stars), F.lit(POSITIVE))


def weak_label_index(rating: Column) -> Column:
    """The same label as 0.0 and 1.0."""
    label = weak_label(rating)
    return F.when(label == NEGATIVE, F.lit(0.0)).when(label == POSITIVE, F.lit(1.0))


def is_mismatch(rating: Column, label: Column) -> Column:
    return known(((rating >= 4) & (label == NEGATIVE)) | ((rating <= 2) & (label == POSITIVE)))


def is_too_short(text: Column, min_words: int = 3) -> Column:
    return text.isNull() | (word_count(text) < min_words)


def is_repetitive(text: Column, threshold: float = 0.5) -> Column:
    """More than ``threshold`` of the tokens repeat an earlier one."""

    def repeats(words: Column) -> Column:
        share = 1 - F.try_divide(F.size(F.array_distinct(words)), F.size(words))
        return (F.size(words) > 1) & (share > threshold)

    return known(bound(tokens(F.lower(text)), repeats))


def keep_short_opinions(is_spam: Column, text: Column, rating: Column, max_chars: int = 30) -> Column:
    """Short text with a clear rating is an opinion, not spam. Null text counts as three characters."""
    short = F.coalesce(F.length(text), F.lit(3)) < max_chars
    return F.when(known(short & ((rating >= 4) | (rating <= 2))), F.lit(False)).otherwise(known(is_spam))


def is_upload_spam(text: Column, rating: Column, min_chars: int = 4) -> Column:
    return known((F.length(text) < min_chars) & (rating == 3))


def flag_reason(short: Column, repetitive: Column, duplicate: Column) -> Column:
    named = [(short, "too_short"), (repetitive, "repetitive"), (duplicate, "near_duplicate")]
    return F.concat_ws(", ", *[F.when(flag, F.lit(name)) for flag, name in named])


def phrase_pattern(phrases: Sequence[str]) -> str:
    """Pattern that finds any phrase as whole words, in any case."""
    edge = f"[^{WORD}]"
    words = "|".join(re.escape(phrase) for phrase in phrases)
    return f"(?i)(?:^|{edge})(?:{words})(?:$|{edge})"


def aspects_of(text: Column, aspects: Mapping[str, Sequence[str]] = ASPECTS) -> Column:
    """Names of the aspects mentioned, in dictionary order.

    Single words are looked up in the set of words of the text. The pattern of a phrase
    of several words is tried only where the phrase occurs at all.
    """
    lowered = F.lower(text)
    single = {name: [p.lower() for p in phrases if " " not in p] for name, phrases in aspects.items()}
    several = {name: [p.lower() for p in phrases if " " in p] for name, phrases in aspects.items()}
    listed = F.array(*[F.lit(word) for words in single.values() for word in words])

    def names(words: Column) -> Column:
        found = []
        for name in aspects:
            hit = F.arrays_overlap(words, F.array(*[F.lit(word) for word in single[name]]))
            for phrase in several[name]:
                hit = hit | (F.contains(lowered, F.lit(phrase)) & lowered.rlike(phrase_pattern([phrase])))
            found.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*found))

    words = F.regexp_extract_all(lowered, F.lit(f"[{WORD}]+"), 0)
    return bound(F.array_intersect(words, listed), names)


def aspects_or_general(text: Column, aspects: Mapping[str, Sequence[str]] = ASPECTS) -> Column:
    return bound(
        aspects_of(text, aspects),
        lambda found: F.when(F.size(found) == 0, F.array(F.lit("General"))).otherwise(found),
    )


def mentions(text: Column, term: str) -> Column:
    """Plain search, any case."""
    return known(F.contains(F.lower(text), F.lit(term.lower())))


def is_anomaly(mismatch: Column, spam: Column) -> Column:
    return known(mismatch) | known(spam)


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"^[{SPACE}]*$")
