"""Predicates and flags. All are safe on raw, all-string columns under ANSI mode."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, CharType, DataType, StringType, VarcharType

_TEXTUAL = (StringType, VarcharType, CharType, BinaryType)


def is_blank(column: Column | str, data_type: DataType | None = None) -> Column:
    """NULL, or nothing but spaces once read as text.

    Pass ``data_type`` when it is known: values of non-text types are never blank,
    so the cast and the trim of every value can be left out of the scan.
    """
    c = F.col(column) if isinstance(column, str) else column
    if data_type is not None and not isinstance(data_type, _TEXTUAL):
        return c.isNull()
    return c.isNull() | (F.trim(c.cast("string")) == "")


def non_blank(column: Column | str) -> Column:
    """True only for a non-empty text; a NULL does not pass a filter on it."""
    c = F.col(column) if isinstance(column, str) else column
    return c != ""


def at_least(column: Column | str, threshold: float) -> Column:
    """Numeric threshold on a column that may still be text; unreadable text gives NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast("double") >= F.lit(float(threshold))


def text_flag(column: Column | str) -> Column:
    """'True' / 'False' text to boolean; anything else gives NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast("boolean")


def any_of(flags: Iterable[Column | str]) -> Column:
    """OR of flags in three-valued logic."""
    columns = [F.col(f) if isinstance(f, str) else f for f in flags]
    return reduce(lambda left, right: left | right, columns)


def still_valid(end_date: Column | str, as_of: str) -> Column:
    """The period has not ended on ``as_of`` (ISO date)."""
    c = F.col(end_date) if isinstance(end_date, str) else end_date
    return F.to_date(c.try_cast("date")) >= F.lit(as_of).cast("date")


def filled(column: Column | str) -> Column:
    """Text that says something: not NULL, not blank and not an empty JSON value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~F.trim(c).isin("", "{}", "[]", "null"), F.lit(False))
