"""Dimensions of the star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strata.functions.dates import month_name, period_key, study_term
from strata.operators.refine import dedup

# Month names and term names of the calendar.
MONTHS = (
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
)
TERMS = ("Ganjil", "Genap")


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """Small table from literals, with an explicit schema.

    Handed over as Arrow it becomes a local relation, whose size the planner knows.
    """
    columns = list(zip(*rows)) if rows else [() for _ in schema]
    table = pa.table({f.name: list(values) for f, values in zip(schema, columns)})
    return spark.createDataFrame(table, schema=schema) if rows else spark.createDataFrame([], schema)


def calendar_dimension(
    years: DataFrame, months: Sequence[str] = MONTHS, terms: tuple[str, str] = TERMS
) -> DataFrame:
    """One row per month of the years ``first_year`` .. ``last_year`` (one row), numbered from 1.

    Carries the period key that facts join on.
    """
    first, last = F.col("first_year"), F.col("last_year")
    month_no = years.select(
        first, F.explode(F.sequence(F.lit(0), (last - first + 1) * 12 - 1).cast("array<int>")).alias("n")
    )
    n = F.col("n")
    return month_no.select(
        (n + 1).alias("calendar_id"),
        (first + F.floor(n / 12)).cast("int").alias("year"),
        (n % 12 + 1).cast("int").alias("month"),
    ).select(
        "calendar_id",
        period_key("year", F.col("month")).alias("period_key"),
        "year",
        study_term(F.col("month"), *terms).alias("term"),
        F.ceil(F.col("month") / 3).cast("int").alias("quarter"),
        "month",
        month_name(F.col("month"), months).alias("month_name"),
    )


def year_range(df: DataFrame, date: str) -> DataFrame:
    """First and last year of a date column, as one row."""
    return df.agg(F.year(F.min(date)).alias("first_year"), F.year(F.max(date)).alias("last_year"))


def fixed_years(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """A given range of years, as one row."""
    return spark.range(1).select(F.lit(first_year).alias("first_year"), F.lit(last_year).alias("last_year"))


def mapped_dimension(
    df: DataFrame,
    key: str,
    columns: Mapping[str, str | Column],
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Project, rename, label or add constants, then keep one row per key."""
    projected = df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    )
    return dedup(projected, [key], order)
