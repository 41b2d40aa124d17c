"""Text cleaning and tokenising as ``Column -> Column`` functions.

The character classes are spelled out because ``\\w`` and ``\\s`` mean ASCII in Java
while reviews come in every script.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.lexicons import STOP_WORDS

# Members of character classes, to be put between brackets.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

_URL = rf"(?:http|www)[^{SPACE}]+"
_TAG = r"(?d)<.*?>"

# Words a Treebank tokeniser splits in two once punctuation is gone.
SPLIT_WORDS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once although ``use`` mentions it repeatedly."""
    return F.transform(F.array(value), use).getItem(0)


def strip_urls(c: Column) -> Column:
    # Looking for the bare words is cheaper than trying the pattern at every character.
    listed = lambda t: t.contains("http") | t.contains("www")
    return bound(c, lambda t: F.when(listed(t), F.regexp_replace(t, _URL, "")).otherwise(t))


def strip_tags(c: Column) -> Column:
    return bound(c, lambda t: F.when(t.contains("<"), F.regexp_replace(t, _TAG, "")).otherwise(t))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def name_emoji(c: Column, names: Mapping[str, str]) -> Column:
    """Replace each listed emoji by its name with a space on both sides; ``operators.emoji`` takes a table of names."""
    ordered = sorted(names.items(), key=lambda pair: -len(pair[0]))
    pairs = F.array(*[F.struct(F.lit(k).alias("mark"), F.lit(f" {v} ").alias("name")) for k, v in ordered])
    named = F.reduce(pairs, c, lambda text, p: F.replace(text, p["mark"], p["name"]))
    return F.when(c.rlike(r"[^\x00-\x7F]"), named).otherwise(c)


def lowered_without_markup(c: Column) -> Column:
    return strip_tags(strip_urls(F.lower(F.coalesce(c, F.lit("")))))


def without_marks(c: Column) -> Column:
    """Drop what is neither word, white space nor ``! ? . , '``."""
    return squeeze(F.regexp_replace(c, f"[^{WORD}{SPACE}!?.,']", " "))


def clean_for_model(c: Column, emoji_names: Mapping[str, str] | None = None) -> Column:
    """Cleaning ahead of a sentiment model; keeps ``! ? . , '``.

    Without ``emoji_names`` every run outside ASCII becomes one space.
    """
    text = lowered_without_markup(c)
    if emoji_names:
        text = name_emoji(text, emoji_names)
    else:
        text = F.regexp_replace(text, r"[^\x00-\x7F]+", " ")
    return without_marks(text)


def clean_for_keywords(c: Column) -> Column:
    """Cleaning ahead of keyword counts; keeps letters, digits and ``_`` of any script."""
    return squeeze(F.regexp_replace(lowered_without_markup(c), f"[^{WORD}{SPACE}]", " "))


def clean_for_features(c: Column) -> Column:
    """Cleaning ahead of bag-of-words features; ASCII only, punctuation deleted, no trimming."""
    ascii_only = F.regexp_replace(lowered_without_markup(c), r"[^\x00-\x7F]", "")
    return F.regexp_replace(ascii_only, r"\p{Punct}", "")


def tokens(c: Column) -> Column:
    """White-space separated tokens; an empty array for empty text."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{WORD}]{{2,}}"), 0)


def split_contractions(c: Column) -> Column:
    """Put a space inside the listed words ("cannot" to "can not")."""
    alternatives = "|".join(f"({left})({right})" for left, right in SPLIT_WORDS)
    first = "".join(f"${2 * i + 1}" for i in range(len(SPLIT_WORDS)))
    second = "".join(f"${2 * i + 2}" for i in range(len(SPLIT_WORDS)))
    return F.regexp_replace(c, rf"\b(?:{alternatives})\b", f"{first} {second}")


def without_words(words: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Drop the listed words, keeping repeats of all others."""
    listed = list(stop_words)
    return F.filter(words, lambda t: ~t.isin(listed)) if listed else words


def longer_than(words: Column, size: int) -> Column:
    return F.filter(words, lambda t: F.length(t) > size)


def lemmatise(words: Column, lemmas: Mapping[str, str]) -> Column:
    """Replace tokens found in a small lemma map; use ``operators.features`` for a lemma table."""
    if not lemmas:
        return words
    table = F.create_map(*[F.lit(part) for pair in lemmas.items() for part in pair])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def feature_tokens(c: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens of feature text before lemmas and the length rule."""
    return without_words(tokens(split_contractions(clean_for_features(c))), stop_words)


def feature_text(
    c: Column,
    stop_words: Iterable[str] = STOP_WORDS,
    lemmas: Mapping[str, str] | None = None,
    min_tokens: int = 5,
) -> Column:
    """Full feature preprocessing; empty text when fewer than ``min_tokens`` tokens remain."""
    words = lemmatise(feature_tokens(c, stop_words), lemmas or {})
    return bound(
        words, lambda w: F.when(F.size(w) < min_tokens, F.lit("")).otherwise(F.array_join(w, " "))
    )


def keyword_tokens(c: Column, stop_words: Iterable[str] = STOP_WORDS, min_length: int = 3) -> Column:
    """Tokens that count as keywords: cleaned, no stop words, at least ``min_length`` long."""
    return longer_than(without_words(tokens(clean_for_keywords(c)), stop_words), min_length - 1)


def word_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit(""))))


def squeezed_word_count(c: Column) -> Column:
    """Word count of text that is already squeezed."""
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(spaces + 1)


def char_length(c: Column) -> Column:
    return F.length(c)
