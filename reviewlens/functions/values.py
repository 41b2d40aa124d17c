"""Dates, numbers, percentages and probabilities as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.schemas import NEGATIVE, POSITIVE


def iso_day(c: Column) -> Column:
    """``yyyy-MM-dd`` text of a date, timestamp or ISO string; null when it cannot be read."""
    return c.cast("string").try_cast("date").cast("string")


_DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def day_first_date(c: Column) -> Column:
    """Date of text written day first, with month names, or ISO, with or without a time; null when it cannot be read."""
    text = F.trim(c.cast("string"))
    forms = [F.try_to_date(text, f"{form}[ H:mm[:ss]]") for form in _DAY_FIRST]
    return F.coalesce(*forms[:3], text.try_cast("date"), *forms[3:])


def number_or(c: Column, default: float) -> Column:
    """Number of a text, ``default`` when null or unreadable."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(number), F.lit(default)).otherwise(F.coalesce(number, F.lit(default)))


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, rounded half to even; 0 when there is nothing to share."""
    return F.when(whole > 0, F.bround(F.try_divide(part, whole) * 100, digits)).otherwise(F.lit(0.0))


def whole_percentage(part: Column, whole: Column) -> Column:
    """Share in whole percent, rounded half up, as dashboards show it."""
    share = F.round(F.try_divide(part * 100, whole), 0)
    return F.when(whole > 0, share).otherwise(F.lit(0)).cast("bigint")


def page_count(total: Column, page_size: int) -> Column:
    return F.ceil(total / F.lit(page_size)).cast("bigint")


def softmax_positive(negative_logit: Column, positive_logit: Column) -> Column:
    """Probability of the positive class, shifted by the larger logit so that exp cannot overflow."""
    top = F.greatest(negative_logit, positive_logit)
    negative, positive = F.exp(negative_logit - top), F.exp(positive_logit - top)
    return positive / (negative + positive)


def label_of(positive_probability: Column) -> Column:
    """A tie goes to the first class, Negative."""
    return F.when(positive_probability > 0.5, F.lit(POSITIVE)).when(
        positive_probability.isNotNull(), F.lit(NEGATIVE)
    )


def confidence_of(positive_probability: Column) -> Column:
    return F.greatest(positive_probability, 1 - positive_probability)


def score_map(positive_probability: Column) -> Column:
    """Label to probability."""
    return F.create_map(
        F.lit(NEGATIVE), 1 - positive_probability, F.lit(POSITIVE), positive_probability
    )
