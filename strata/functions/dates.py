"""Dates, period keys and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def year_of(column: Column | str) -> Column:
    """Year of a date, timestamp or ISO text; unreadable text gives NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.year(c.try_cast("date"))


def period_key(year: Column | str, month: int | Column = 12) -> Column:
    """``year * 100 + month`` as int; the year may still be text."""
    c = F.col(year) if isinstance(year, str) else year
    m = F.lit(month) if isinstance(month, int) else month
    return (c.try_cast("int") * 100 + m).cast("int")


def study_term(month: Column, odd: str, even: str) -> Column:
    """Odd term from August to January, even term otherwise."""
    return F.when((month >= 8) | (month <= 1), F.lit(odd)).otherwise(F.lit(even))


def month_name(month: Column, names: Sequence[str]) -> Column:
    """Name of month 1..12 out of a list of twelve."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), month.cast("int"))


def first_timestamp(*candidates: Column | str) -> Column:
    """First non-empty candidate as a timestamp; a text that is no timestamp gives NULL."""
    texts = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in candidates]
    return F.coalesce(*texts).try_cast("timestamp")


def age_days(moment: Column, as_of: str) -> Column:
    """Fractional days from ``moment`` to ``as_of`` (ISO timestamp)."""
    reference = F.lit(as_of).cast("timestamp")
    return (F.unix_micros(reference) - F.unix_micros(moment)) / F.lit(86_400_000_000.0)


def freshness_score(moment: Column, as_of: str) -> Column:
    """Score of an age: fresher than a week, month, quarter, half year, older; 0 if unknown."""
    age = age_days(moment, as_of)
    # Fixed values: (age limit in days, score).
    steps = ((7, 100), (30, 90), (90, 75), (180, 60))
    score = F.when(moment.isNull(), 0)
    for limit, points in steps:
        score = score.when(age <= limit, points)
    return score.otherwise(40).cast("int")
