"""Score arithmetic, casts and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingomark.functions.text import SCORE_MAX


def ensemble_mean(first: Column, second: Column) -> Column:
    return (first + second) / 2


def display_score(score: Column, digits: int = 1) -> Column:
    return F.round(score, digits)


def score_percent(score: Column) -> Column:
    """Width of the score bar in percent."""
    return score / SCORE_MAX * 100


def to_number(value: Column) -> Column:
    """Cast to double; text that is no number becomes NULL."""
    return value.try_cast("double")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def mse_term(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)
