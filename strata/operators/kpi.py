"""KPI facts: a measure per period and unit, its yearly target and the attainment.

Every fact function returns ``fact_id, period_key, <unit>, <measures>, <value>, target,
attainment``. Targets are a long table ``(year, code, target, target_label)`` and joined
on the year, never looked up by a Python function per row.

Scale notes
-----------
* Measures are aggregated before anything is joined, so joins see one row per group.
* Target tables come from literals; the planner knows their size and broadcasts them
  only while they are small.
* Institution-wide counts enter a fact as scalar subqueries, not as a cross join or a
  driver-side count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from strata.functions.dates import period_key
from strata.functions.documents import json_field
from strata.functions.numbers import (
    attainment_pct,
    floored,
    progress_pct,
    ratio,
    share_pct,
    surrogate_key,
    target_status,
)
from strata.functions.predicates import any_of
from strata.operators.containment import containing
from strata.operators.dims import literal_table
from strata.operators.refine import union_all

TARGET_SCHEMA = StructType(
    [
        StructField("year", IntegerType()),
        StructField("code", StringType()),
        StructField("target", DoubleType()),
        StructField("target_label", StringType()),
    ]
)


@dataclass(frozen=True)
class Kpi:
    """How one indicator is measured against its target.

    ``fallback_year`` gives the target of years without one. ``unknown_year`` is the
    target of rows whose year is NULL; None means the fallback year's. ``floor`` keeps a
    tiny target from blowing up the attainment.
    """

    code: str
    value: str
    targets: DataFrame
    fallback_year: int
    floor: float | None = 1.0
    unknown_year: float | None = None
    numerator: str = "sum"

    def __post_init__(self) -> None:
        if self.numerator not in ("sum", "any"):
            raise ValueError("numerator must be 'sum' (categories add up) or 'any' (each entity once)")


def target_table(spark: SparkSession, targets: Mapping[int, Mapping[str, float | str]]) -> DataFrame:
    """Year -> code -> target as a long table; text targets go to ``target_label``."""
    rows = [
        (year, code, None, value) if isinstance(value, str) else (year, code, float(value), None)
        for year, codes in targets.items()
        for code, value in codes.items()
    ]
    return literal_table(spark, rows, TARGET_SCHEMA)


def _by_year(kpi: Kpi) -> DataFrame:
    rows = kpi.targets.where(F.col("code") == kpi.code)
    return rows.select(F.col("year").alias("_target_year"), "target")


def fixed_target(kpi: Kpi) -> Column:
    """The fallback year's target, or 0 if it has none; a scalar subquery."""
    chosen = _by_year(kpi).where(F.col("_target_year") == kpi.fallback_year).select(F.max("target"))
    return F.coalesce(chosen.scalar(), F.lit(0.0))


def with_target(df: DataFrame, kpi: Kpi, year: str) -> DataFrame:
    """Add ``target`` by year; years without one get the fallback year's."""
    joined = df.join(_by_year(kpi), F.col(year) == F.col("_target_year"), "left").drop("_target_year")
    target = F.coalesce("target", fixed_target(kpi))
    if kpi.unknown_year is not None:
        target = F.when(F.col(year).isNull(), F.lit(float(kpi.unknown_year))).otherwise(target)
    return joined.withColumn("target", target)


def _fact(
    df: DataFrame,
    kpi: Kpi,
    year: str,
    units: Sequence[str],
    measures: Sequence[str],
    unknown_period: int | None = None,
) -> DataFrame:
    """Target, attainment, period key and surrogate id in the common column order.

    A frame that brings its ``target`` keeps it. Rows with an unknown year have no period
    unless ``unknown_period`` names one.
    """
    targeted = df if "target" in df.columns else with_target(df, kpi, year)
    period = period_key(F.coalesce(F.col(year), F.lit(unknown_period)))
    finished = targeted.withColumns(
        {"attainment": attainment_pct(F.col(kpi.value), F.col("target"), kpi.floor), "period_key": period}
    )
    key = surrogate_key(F.lit(kpi.code), F.col(year), *units)
    return finished.select(
        key.alias("fact_id"), "period_key", *units, *measures, kpi.value, "target", "attainment"
    )


def _total(names: Sequence[str]) -> Column:
    return reduce(lambda left, right: left + right, [F.col(n) for n in names])


def _flag_counts(flags: Mapping[str, str | Column]) -> list[Column]:
    """Rows with a true flag; a NULL flag counts nowhere, a group of NULL flags counts NULL."""
    return [
        F.sum((F.col(f) if isinstance(f, str) else f).cast("int")).alias(name) for name, f in flags.items()
    ]


def outcome_share(
    df: DataFrame,
    kpi: Kpi,
    year: str,
    unit: str,
    total: str,
    outcomes: Mapping[str, str],
    remainder: tuple[str, str],
) -> DataFrame:
    """Share of a cohort with one of several outcomes.

    ``outcomes`` maps a measure to its flag; ``remainder`` is (measure, any-flag) and
    counts the rows whose any-flag is false.
    """
    name, any_flag = remainder
    counted = df.groupBy(year, unit).agg(
        F.count(F.lit(1)).alias(total),
        *_flag_counts(outcomes),
        *_flag_counts({name: ~F.col(any_flag)}),
    )
    valued = counted.withColumn(kpi.value, share_pct(_total(list(outcomes)), F.col(total)))
    return _fact(valued, kpi, year, [unit], [total, *outcomes, name])


def threshold_share(
    df: DataFrame,
    events: DataFrame,
    kpi: Kpi,
    key: str,
    year: str,
    unit: str,
    total: str,
    flag: str,
    flagged: str,
    event_year: str,
    holders: str,
    qualified: str,
    per_unit: bool = False,
) -> DataFrame:
    """Share of entities over a threshold, with credit for entities holding an event of their year.

    ``numerator='sum'`` adds the distinct event holders of the year to the flagged count;
    they are counted institution-wide, or within the unit with ``per_unit``.
    ``numerator='any'`` counts an entity once if it is flagged or holds an event.
    """
    held = events.select(F.col(key), F.col(event_year).alias(year)).distinct()
    if kpi.numerator == "sum" and not per_unit:
        groups = df.groupBy(year, unit).agg(F.count(F.lit(1)).alias(total), *_flag_counts({flagged: flag}))
        by_year = held.groupBy(year).agg(F.count(key).alias(holders))
        counted = groups.join(by_year, year, "left").withColumn(holders, F.coalesce(holders, F.lit(0)))
        counted = counted.withColumn(qualified, F.col(flagged) + F.col(holders))
    else:
        marked = df.select(key, year, unit, flag).join(held.withColumn("_held", F.lit(True)), [key, year], "left")
        has_event = F.coalesce("_held", F.lit(False))
        counted = marked.groupBy(year, unit).agg(
            F.count(F.lit(1)).alias(total),
            *_flag_counts({flagged: flag, holders: has_event}),
            F.count_if(F.coalesce(F.col(flag), F.lit(False)) | has_event).alias("_any"),
        )
        either = F.col("_any") if kpi.numerator == "any" else F.col(flagged) + F.col(holders)
        counted = counted.withColumn(qualified, either)
    valued = counted.withColumn(kpi.value, share_pct(F.col(qualified), F.col(total)))
    return _fact(valued, kpi, year, [unit], [total, flagged, holders, qualified])


def participation_share(
    entities: DataFrame,
    activity: DataFrame,
    kpi: Kpi,
    key: str,
    year: str,
    unit: str,
    kind: str,
    kinds: Mapping[str, str],
    total: str,
    qualified: str,
) -> DataFrame:
    """Share of entities taking part in any of several kinds of activity.

    ``kinds`` maps a measure to its kind. Entities without any activity keep a NULL year
    and appear in the fallback period.
    """
    flags = [f"_has_{i}" for i in range(len(kinds))]
    pivoted = activity.groupBy(key, year).agg(
        *[F.bool_or(F.col(kind).eqNullSafe(k)).alias(f) for f, k in zip(flags, kinds.values())]
    )
    joined = entities.select(key, unit).join(pivoted, key, "left")
    counted = joined.groupBy(year, unit).agg(
        F.count(F.lit(1)).alias(total),
        *[F.count_if(f).alias(measure) for f, measure in zip(flags, kinds)],
        F.count_if(any_of(flags)).alias("_any"),
    )
    counted = counted.withColumn(qualified, F.col("_any") if kpi.numerator == "any" else _total(list(kinds)))
    valued = counted.withColumn(kpi.value, share_pct(F.col(qualified), F.col(total)))
    return _fact(valued, kpi, year, [unit], [total, *kinds, qualified], kpi.fallback_year)


def qualification_share(
    df: DataFrame,
    kpi: Kpi,
    unit: str,
    total: str,
    flags: Mapping[str, str],
    qualified: str,
) -> DataFrame:
    """Snapshot share of qualified entities per unit, against the fallback year's target."""
    counted = df.groupBy(unit).agg(
        F.count(F.lit(1)).alias(total),
        *_flag_counts(flags),
        F.count_if(any_of(flags.values())).alias("_any"),
    )
    counted = counted.withColumn(qualified, F.col("_any") if kpi.numerator == "any" else _total(list(flags)))
    valued = counted.withColumn(kpi.value, share_pct(F.col(qualified), F.col(total)))
    snapshot = valued.withColumns({"_year": F.lit(kpi.fallback_year), "target": fixed_target(kpi)})
    return _fact(snapshot, kpi, "_year", [unit], [total, *flags, qualified])


def output_per_head(
    outputs: DataFrame,
    heads: DataFrame,
    kpi: Kpi,
    year: str,
    group: str,
    flags: Mapping[str, str],
    head_count: str,
    eligible: str,
) -> DataFrame:
    """Eligible outputs of a group and year per head of the group, four digits."""
    counted = outputs.groupBy(group, year).agg(*_flag_counts(flags))
    headed = counted.join(heads.groupBy(group).agg(F.count(F.lit(1)).alias(head_count)), group, "left")
    valued = headed.withColumn(eligible, _total(list(flags))).withColumn(
        kpi.value, ratio(F.col(eligible), floored(F.col(head_count).cast("double"), 1))
    )
    return _fact(valued, kpi, year, [group], [head_count, *flags, eligible])


def coverage_share(
    universe: DataFrame,
    covered: DataFrame,
    kpi: Kpi,
    key: str,
    years: Sequence[int],
    total: str,
    hits: str,
    strict: bool = False,
) -> DataFrame:
    """Distinct non-blank covered keys in percent of the universe, repeated against each year's target.

    With ``strict`` only keys of the universe count as covered, so the share stays within 100.
    """
    keys = covered.where(F.col(key).cast("string") != "").select(key)
    if strict:
        keys = keys.join(universe.select(key), key, "left_semi")
    spark = universe.sparkSession
    yearly = literal_table(spark, [(y,) for y in years], StructType([StructField("_year", IntegerType())]))
    counted = yearly.withColumns(
        {
            total: universe.select(F.count(F.lit(1))).scalar(),
            hits: keys.select(F.count_distinct(key)).scalar(),
        }
    )
    valued = counted.withColumn(kpi.value, share_pct(F.col(hits), floored(F.col(total).cast("double"), 1)))
    return _fact(valued, kpi, "_year", [], [total, hits])


def capped_share(
    df: DataFrame,
    kpi: Kpi,
    year: str,
    unit: str,
    total: str,
    parts: Sequence[str],
    qualified: str,
) -> DataFrame:
    """Sum of overlapping parts, capped by the total, in percent of the total."""
    valued = df.withColumn(qualified, F.least(_total(parts), F.col(total))).withColumn(
        kpi.value, share_pct(F.col(qualified), F.col(total))
    )
    return _fact(valued, kpi, year, [unit], [total, *parts, qualified])


def realisation(
    df: DataFrame,
    targets: DataFrame,
    year: str,
    planned: str,
    realised: str,
    label_code: str,
    target_code: str,
    label_target: str,
    decimals: str = "decimal(18,2)",
) -> DataFrame:
    """Planned and realised amounts by year, their share, a derived index and the year's label and target.

    Amounts are summed as decimals, so the result does not depend on the order of the rows.
    """
    amount = lambda c: F.sum(F.col(c).try_cast(decimals)).cast("double")
    by_code = lambda code, value, name: targets.where(F.col("code") == code).select(
        F.col("year").alias(year), F.col(value).alias(name)
    )
    totals = df.groupBy(year).agg(amount(planned).alias("planned_total"), amount(realised).alias("realised_total"))
    valued = totals.withColumn("realised_pct", share_pct(F.col("realised_total"), F.col("planned_total")))
    return (
        valued.join(by_code(label_code, "target_label", "label"), year, "left")
        .join(by_code(target_code, "target", "target"), year, "left")
        .select(
            surrogate_key(F.lit(target_code), F.col(year)).alias("fact_id"),
            period_key(year).alias("period_key"),
            "label",
            F.round(F.col("realised_pct") * 0.95, 1).alias("index_value"),
            F.col("realised_pct").alias("performance"),
            "planned_total",
            "realised_total",
            "realised_pct",
            F.lit(label_target).alias("label_target"),
            "target",
        )
    )


def scorecard(facts: Sequence[tuple[str, str, str, DataFrame, str]], target: str = "target") -> DataFrame:
    """Period x indicator: mean value and target, unit and status.

    ``facts`` holds (code, name, unit, fact, value column); each fact is averaged before
    the union.
    """
    rows = [
        fact.groupBy("period_key")
        .agg(F.avg(value).alias("v"), F.avg(target).alias("t"))
        .select(
            "period_key",
            F.lit(code).alias("code"),
            F.lit(name).alias("name"),
            F.round("v", 2).alias("value"),
            F.round("t", 2).alias("target"),
            F.lit(unit).alias("unit"),
            target_status(F.col("v"), F.col("t")).alias("status"),
        )
        for code, name, unit, fact, value in facts
    ]
    return union_all(rows).select(surrogate_key("period_key", "code").alias("fact_id"), "*")


def kpi_summary(fact: DataFrame, table_name: str, value: str, unit: str = "%") -> DataFrame:
    """One row: mean value, target and attainment of a fact, with the status of the unrounded means."""
    means = fact.agg(
        F.avg(value).alias("v"), F.avg("target").alias("t"), F.avg("attainment").alias("a")
    )
    return means.select(
        F.lit(table_name).alias("table_name"),
        F.round("v", 2).alias("value"),
        F.round("t", 2).alias("target"),
        F.round("a", 2).alias("attainment"),
        target_status(F.col("v"), F.col("t")).alias("status"),
        F.lit(unit).alias("unit"),
    )


def match_kpi_assets(assets: DataFrame, kpis: DataFrame | Sequence[Mapping[str, str]]) -> DataFrame:
    """The asset of each KPI (``code``, ``fact``): by name, qualified name, part of the name or stated code.

    KPIs may be a table of any size: names and stated codes are equi-joins, containment goes by posted n-grams. An asset
    counts once per code; of several matches the first qualified name counts. KPIs without an asset are absent.
    """
    if not isinstance(kpis, DataFrame):
        kpis = assets.sparkSession.createDataFrame([(k["code"], k["fact"]) for k in kpis], "code string, fact string")
    kpis = kpis.select("code", "fact").where("code IS NOT NULL").distinct()
    parts = kpis.select("code", F.replace("fact", F.lit("fact_"), F.lit("")).alias("pattern")).distinct()
    own = ["name", "qualified", "is_gold", "stated", "qualified_name"]
    known = assets.select(
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("qualified_name", F.lit("")).alias("qualified"),
        F.col("layer").eqNullSafe("gold").alias("is_gold"),
        json_field("profiling", "kpi.iku_code").alias("stated"),
        "qualified_name",
    ).groupBy(*own).agg(F.count(F.lit(1)).alias("copies"))
    gold = known.where("is_gold")
    in_qualified = containing(known.select("qualified"), kpis.select("fact")).withColumnsRenamed({"text": "qualified", "pattern": "fact"})
    in_name = containing(gold.select("name"), parts.select("pattern")).withColumnRenamed("text", "name")
    hits = [
        known.join(kpis.select("code", F.col("fact").alias("name")), "name"),
        known.join(in_qualified, "qualified").join(kpis, "fact"),
        gold.join(in_name, "name").join(parts, "pattern"),
        known.join(kpis.select("code", F.col("code").alias("stated")).distinct(), "stated"),
    ]
    found = reduce(DataFrame.unionByName, [h.select("code", *own, "copies") for h in hits]).distinct()
    return found.groupBy("code").agg(F.min("qualified_name").alias("qualified_name"), F.sum("copies").alias("matches"))


def progress(scores: DataFrame) -> DataFrame:
    """Progress percentage of scorecard rows; ratio indicators are relative to their target."""
    shown = progress_pct(F.col("value"), F.col("target"), F.col("unit") == "Rasio")
    return scores.withColumn("progress", F.round(shown, 2))


def gold_profile(
    df: DataFrame, table_name: str, table_type: str, sources: Sequence[str], summary: DataFrame | None = None
) -> DataFrame:
    """One row on a gold table: rows, columns, schema, sources and, for a KPI fact, its summary."""
    schema = [F.lit(x) for f in df.schema for x in (f.name, str(f.dataType))]
    profile = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table_name).alias("table_name"),
        F.lit(table_type).alias("table_type"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.create_map(*schema).alias("schema"),
        F.array(*[F.lit(s) for s in sources]).cast("array<string>").alias("sources"),
    )
    kpi_type = "struct<value:double,target:double,attainment:double,status:string,unit:string>"
    packed = F.lit(None) if summary is None else summary.select(
        F.struct("value", "target", "attainment", "status", "unit")
    ).scalar()
    return profile.withColumn("sample_kpi", packed.cast(kpi_type))
