import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import rules, values


def on(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


@pytest.mark.parametrize(
    "rating, label",
    [("1", "Negative"), ("2", "Negative"), ("3", None), ("4.0", "Positive"), ("5", "Positive"), ("x", None), (None, None), ("NaN", None)],
)
def test_weak_label(spark, rating, label):
    index = {"Negative": 0.0, "Positive": 1.0}.get(label)
    assert on(spark, "r string", (rating,), rules.weak_label(F.col("r")), rules.weak_label_index(F.col("r"))) == (label, index)


@pytest.mark.parametrize(
    "stars, label, flag",
    [(4.0, "Negative", True), (5.0, "Positive", False), (2.0, "Positive", True), (3.0, "Negative", False), (None, "Negative", False), (5.0, None, False)],
)
def test_mismatch(spark, stars, label, flag):
    assert on(spark, "s double, l string", (stars, label), rules.is_mismatch(F.col("s"), F.col("l"))) == (flag,)


@pytest.mark.parametrize("text, flag", [("meh", True), ("not bad", True), ("quite a find", False), (None, True), ("", True)])
def test_too_short(spark, text, flag):
    assert on(spark, "t string", (text,), rules.is_too_short(F.col("t"))) == (flag,)


@pytest.mark.parametrize(
    "text, flag",
    [
        ("buy buy buy buy buy", True),
        ("Good good", False),  # exactly one half
        ("a A a b", False),
        ("a a a b", False),
        ("a a a a b", True),
        ("every word here occurs once", False),
        ("single", False),
        ("", False),
        (None, False),
        ("good, good good. good", False),
    ],
)
def test_repetition(spark, text, flag):
    assert on(spark, "t string", (text,), rules.is_repetitive(F.col("t"))) == (flag,)


@pytest.mark.parametrize(
    "spam, text, stars, kept",
    [
        (True, "Good", 5.0, False),
        (True, "Good", 3.0, True),
        (True, "Good", None, True),
        (True, "x" * 30, 5.0, True),
        (True, None, 1.0, False),
        (None, "Good", 3.0, False),
    ],
)
def test_short_opinions(spark, spam, text, stars, kept):
    flag = rules.keep_short_opinions(F.col("b"), F.col("t"), F.col("s"))
    assert on(spark, "b boolean, t string, s double", (spam, text, stars), flag) == (kept,)


def test_upload_spam(spark):
    flag = rules.is_upload_spam(F.col("t"), F.col("s"))
    for text, stars, spam in [("meh", 3.0, True), ("mehh", 3.0, False), ("meh", 4.0, False)]:
        assert on(spark, "t string, s double", (text, stars), flag) == (spam,)


def test_flag_reason(spark):
    reason = rules.flag_reason(F.col("a"), F.col("b"), F.col("c"))
    assert on(spark, "a boolean, b boolean, c boolean", (True, False, True), reason) == ("too_short, near_duplicate",)
    assert on(spark, "a boolean, b boolean, c boolean", (False, False, False), reason) == ("",)


@pytest.mark.parametrize(
    "text, found",
    [
        ("After the UPDATE the premium plan got slow", ["Pricing", "Bugs"]),
        ("great matches only", []),
        ("found my date here", ["Matches"]),
        ("dark mode please", ["UI/UX"]),
        ("dark  mode please", []),
        ("darkmode not workings", []),
        ("not working at all", ["Bugs"]),
        ("it is super likely", []),
        ("ui-design, fake_bot", ["UI/UX"]),
        ("uiü", []),
        ("Cheers to the team", []),
        ("", []),
    ],
)
def test_aspects(spark, text, found):
    assert on(spark, "t string", (text,), rules.aspects_of(F.col("t"))) == (found,)
    assert on(spark, "t string", (text,), rules.aspects_or_general(F.col("t"))) == (found or ["General"],)


def test_dates(spark):
    day = lambda s: on(spark, "d string", (s,), values.day_first_date(F.col("d")))[0]
    assert day("13/02/2025") == day("2025-02-13") == day("13-2-2025") == dt.date(2025, 2, 13)
    assert day("03/04/2025") == dt.date(2025, 4, 3)
    assert day("soon") is None and day(None) is None
    for written in ("05/01/2025 10:30", "5 Jan 2025", "5 January 2025 07:00:30", "Jan 5, 2025", "05/01/25", "2025-01-05 10:30"):
        assert day(written) == dt.date(2025, 1, 5), written
    assert on(spark, "d string", ("2025-02-30",), values.iso_day(F.col("d"))) == (None,)
    assert on(spark, "d string", ("2025-02-03 10:11:12",), values.iso_day(F.col("d"))) == ("2025-02-03",)


def test_numbers(spark):
    for raw, number in [("4", 4.0), (" 2.5 ", 2.5), ("abc", 3.0), ("", 3.0), (None, 3.0), ("NaN", 3.0)]:
        assert on(spark, "n string", (raw,), values.number_or(F.col("n"), 3.0)) == (number,)


def test_percentages(spark):
    pair = "a long, b long"
    assert on(spark, pair, (49, 400), values.percentage(F.col("a"), F.col("b"))) == (12.2,)  # 12.25 to even
    assert on(spark, pair, (0, 0), values.percentage(F.col("a"), F.col("b"))) == (0.0,)
    assert on(spark, pair, (1, 8), values.whole_percentage(F.col("a"), F.col("b"))) == (13,)
    assert on(spark, pair, (1, 0), values.whole_percentage(F.col("a"), F.col("b"))) == (0,)
    assert on(spark, pair, (41, 0), values.page_count(F.col("a"), 20)) == (3,)


def test_probabilities(spark):
    p = values.softmax_positive(F.col("n"), F.col("p"))
    assert on(spark, "n double, p double", (1000.0, 1000.0), p, values.label_of(p)) == (0.5, "Negative")
    assert on(spark, "n double, p double", (-2000.0, 2000.0), p, values.label_of(p)) == (1.0, "Positive")
    scores = on(spark, "n double, p double", (0.0, 1.0), values.score_map(p))[0]
    assert scores["Positive"] == pytest.approx(0.7310586) and sum(scores.values()) == pytest.approx(1.0)
