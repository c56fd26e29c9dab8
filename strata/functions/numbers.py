"""Shares, scales and status words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; NULL when the whole is 0 or NULL."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded quotient; NULL when the whole is 0 or NULL."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def floored(value: Column, floor: float | None) -> Column:
    """Denominator floor; NULL counts as the floor. Without a floor the value is kept."""
    return value if floor is None else F.greatest(value, F.lit(float(floor)))


def attainment_pct(value: Column, target: Column, floor: float | None = None) -> Column:
    """Value in percent of its (floored) target, two digits."""
    return share_pct(value, floored(target.cast("double"), floor))


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def five_point(pct: Column) -> Column:
    """0..100 to the scale 1..5."""
    return clamp(F.round(pct / 20).cast("int"), 1, 5).cast("int")


def gate_status(score: Column, pass_at: float = 80, quarantine_at: float = 60) -> Column:
    """Quality score to PASS / QUARANTINE / REJECT."""
    return (
        F.when(score >= pass_at, "PASS").when(score >= quarantine_at, "QUARANTINE").otherwise("REJECT")
    )


# Status words of met, nearly met and missed targets.
STATUS_WORDS = ("Tercapai", "On Track", "Tidak Tercapai")


def target_status(value: Column, target: Column, words: tuple[str, str, str] = STATUS_WORDS) -> Column:
    """Met at the target, near from 80 % of it, else missed; empty when either side is unknown."""
    met, near, missed = words
    return (
        F.when(value.isNull() | target.isNull(), "")
        .when(value >= target, met)
        .when(value >= target * 0.8, near)
        .otherwise(missed)
    )


def progress_pct(value: Column, target: Column, is_ratio: Column | bool = False) -> Column:
    """Progress bar value: at most 100, ratios relative to the target, 0 without value or target."""
    relative = F.try_divide(value, target) * 100
    ratio_flag = F.lit(is_ratio) if isinstance(is_ratio, bool) else is_ratio
    shown = F.least(F.when(ratio_flag, relative).otherwise(value), F.lit(100.0))
    known = value.isNotNull() & target.isNotNull() & (target != 0)
    return F.when(known, shown).otherwise(F.lit(0.0))


def surrogate_key(*business_key: Column | str) -> Column:
    """Stable id from the business key; needs neither a shuffle nor an order. The place of a NULL counts."""
    columns = [F.col(c) if isinstance(c, str) else c for c in business_key]
    return F.xxhash64(*[part for c in columns for part in (c.isNull(), c)])
