"""Column profiles and the quality gate.

Scale notes
-----------
* The exact profile takes columns in batches of at most ``BATCH``: whole numbers (and what
  maps to them one to one), fractions, texts. A batch turns a row into as many (column,
  value) pairs as it has columns, never more, counts equal pairs before the shuffle, so a
  hot value costs one row per task, and then counts the pairs of each column. One pass
  gives rows, blanks and distinct values; the columns of a table are read once in total.
  Long texts enter as SHA-512 digests of the whole text, so the shuffle does not carry
  documents. Arrays, structs and maps are aggregated one at a time.
* ``plan="per_column"`` is one aggregate per column, unioned.
* ``plan="once"`` is for frames that are not stored: it evaluates the frame a single time,
  turns each row into (column, value) pairs and counts equal pairs before the shuffle.
* The gate needs no distinct counts, so it is a single pass with one row per task
  shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, MapType,
    ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

from strata.functions.numbers import gate_status
from strata.functions.predicates import is_blank
from strata.operators.refine import union_all

DISTINCT_MODES = ("exact", "approx", "text")
PLANS = ("batched", "per_column", "once")
BATCH = 24  # columns that are turned into pairs together


# Texts longer than this many bytes are compared by a digest that is longer still, so it never equals a text kept whole.
LONG_TEXT = 128


def _countable(name: str, data_type: DataType) -> Column:
    """A value with the same equality that is cheap to shuffle."""
    column = F.col(f"`{name}`")
    if isinstance(data_type, MapType):
        column = F.to_json(column)
    elif not isinstance(data_type, StringType):
        return column
    return F.when(F.octet_length(column) > LONG_TEXT, F.concat(F.sha2(column, 512), F.lit("+"))).otherwise(column)


def _distinct(name: str, data_type: DataType, mode: str) -> Column:
    column = _countable(name, data_type)
    if mode == "approx":
        return F.approx_count_distinct(column)
    if mode == "text":
        return F.count_distinct(F.coalesce(column.cast("string"), F.lit("")))
    return F.count_distinct(column)


def _stats(table_name: str, position: Column, name: Column, data_type: Column) -> list[Column | str]:
    complete = (F.col("row_count") - F.col("null_count")) / F.col("row_count") * 100
    return [
        F.lit(table_name).alias("table_name"),
        position.alias("position"),
        name.alias("column_name"),
        data_type.alias("data_type"),
        "row_count",
        "null_count",
        F.round(F.col("null_count") / F.col("row_count") * 100, 2).alias("null_pct"),
        "distinct_count",
        F.round(complete, 2).alias("completeness_pct"),
    ]


def profile_columns(
    df: DataFrame, table_name: str, distinct: str = "exact", plan: str = "batched"
) -> DataFrame:
    """One row per column: blanks, distinct values and completeness; no rows for an empty table.

    ``distinct`` is ``exact`` (NULL is no value), ``approx`` (one pass over all columns,
    HyperLogLog) or ``text`` (values as untrimmed text, NULL and '' are one value).
    ``plan`` is ``batched`` or ``per_column`` for stored tables and ``once`` for frames that
    are costly to evaluate; all give the same rows.
    """
    if distinct not in DISTINCT_MODES:
        raise ValueError(f"distinct must be one of {DISTINCT_MODES}")
    if plan not in PLANS:
        raise ValueError(f"plan must be one of {PLANS}")
    if distinct == "approx":
        return _profile_one_pass(df, table_name)
    if plan == "once":
        return _profile_pairs(df, table_name, distinct)
    fields = list(enumerate(df.schema))
    if plan == "per_column":
        return union_all([_profile_column(df, table_name, i, f, distinct) for i, f in fields])
    kinds: dict[str | None, list[tuple[int, StructField]]] = {}
    for i, f in fields:
        kinds.setdefault(_kind(f.dataType, distinct), []).append((i, f))
    parts = [_profile_column(df, table_name, i, f, distinct) for i, f in kinds.pop(None, [])]
    for kind, own in kinds.items():
        batches = -(-len(own) // BATCH)
        parts += [_profile_batch(df, table_name, own[k::batches], kind, distinct) for k in range(batches)]
    return union_all(parts)


def _profile_column(df: DataFrame, table_name: str, position: int, field: StructField, distinct: str) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(is_blank(f"`{field.name}`", field.dataType)).alias("null_count"),
        _distinct(field.name, field.dataType, distinct).alias("distinct_count"),
    )
    return counts.where("row_count > 0").select(*_stats(table_name, F.lit(position), F.lit(field.name), F.lit(str(field.dataType))))


def _kind(data_type: DataType, distinct: str) -> str | None:
    """What the values of a type are compared as: ``long``, ``double``, ``text``, or None for nested values."""
    if isinstance(data_type, (ArrayType, StructType, MapType)):
        return None
    if distinct == "text":
        return "text"
    if isinstance(data_type, (ByteType, ShortType, IntegerType, LongType, BooleanType, DateType, TimestampType, TimestampNTZType)):
        return "long"
    return "double" if isinstance(data_type, (DoubleType, FloatType)) else "text"


def _key(field: StructField, kind: str) -> Column:
    """A value of ``kind`` that is equal exactly when the field's values are, and NULL when they are."""
    column = F.col(f"`{field.name}`")
    if kind == "double":
        return column.cast("double")
    if kind == "long":
        if isinstance(field.dataType, DateType):
            return F.unix_date(column).cast("long")
        if isinstance(field.dataType, TimestampType):
            return F.unix_micros(column)
        if isinstance(field.dataType, TimestampNTZType):  # free of the session's time zone
            return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), column)
        return column.cast("long")
    text = column.cast("string")
    if isinstance(field.dataType, (StringType, BinaryType)):  # a blank text stays, so that it can be told
        long_text = (F.octet_length(text) > LONG_TEXT) & (F.trim(text) != "")
        return F.when(long_text, F.concat(F.sha2(text, 512), F.lit("+"))).otherwise(text)
    return text


def _profile_batch(df: DataFrame, table_name: str, fields: list[tuple[int, StructField]], kind: str, distinct: str) -> DataFrame:
    """The rows of some columns of one kind: pairs of column and value, counted twice."""
    keys = df.select(*[_key(f, kind).alias(f"v{i}") for i, f in fields])
    pairs = keys.select(F.stack(F.lit(len(fields)), *[x for i, _ in fields for x in (F.lit(i), F.col(f"v{i}"))]).alias("position", "value"))
    values = pairs.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
    blank = is_blank("value", None if kind == "text" else LongType())
    values_seen = F.count("value")
    if distinct == "text":  # NULL and '' are one value
        values_seen = values_seen + F.max(F.col("value").isNull().cast("int")) * (1 - F.max(F.coalesce(F.col("value") == "", F.lit(False)).cast("int")))
    counted = values.groupBy("position").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("null_count"), values_seen.alias("distinct_count")
    )
    name_of = F.create_map(*[F.lit(x) for i, f in fields for x in (i, f.name)])
    type_of = F.create_map(*[F.lit(x) for i, f in fields for x in (i, str(f.dataType))])
    return counted.select(*_stats(table_name, F.col("position"), name_of[F.col("position")], type_of[F.col("position")]))


def _value_text(field: StructField) -> Column:
    """Text that is equal exactly when the values are: one zero, instants free of the time zone."""
    column = _countable(field.name, field.dataType)
    if isinstance(field.dataType, (DoubleType, FloatType)):
        column = column + F.lit(0.0).cast(field.dataType)
    elif isinstance(field.dataType, TimestampType):
        column = F.unix_micros(column)
    elif isinstance(field.dataType, (ArrayType, StructType)):  # a NULL inside is not the text "null"
        column = F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def _profile_pairs(df: DataFrame, table_name: str, distinct: str) -> DataFrame:
    fields = list(enumerate(df.schema))
    value = lambda f: F.coalesce(_value_text(f), F.lit("")) if distinct == "text" else _value_text(f)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                value(f).alias("value"),
                is_blank(f"`{f.name}`", f.dataType).cast("int").alias("blank"),
            )
            for i, f in fields
        ]
    )
    values = (
        df.select(F.inline(pairs))
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("blank").alias("blanks"))
    )
    counted = values.groupBy("position").agg(
        F.sum("n").alias("row_count"), F.sum("blanks").alias("null_count"), F.count("value").alias("distinct_count")
    )
    name_of = F.create_map(*[F.lit(x) for i, f in fields for x in (i, f.name)])
    type_of = F.create_map(*[F.lit(x) for i, f in fields for x in (i, str(f.dataType))])
    position = F.col("position")
    return counted.select(*_stats(table_name, position, name_of[position], type_of[position]))


def _profile_one_pass(df: DataFrame, table_name: str) -> DataFrame:
    fields = list(enumerate(df.schema))
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(is_blank(f"`{f.name}`", f.dataType)).alias(f"nulls_{i}") for i, f in fields],
        *[_distinct(f.name, f.dataType, "approx").alias(f"values_{i}") for i, f in fields],
    ).where("row_count > 0")
    entries = F.array(
        *[
            F.struct(
                F.lit(table_name).alias("table_name"),
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(str(f.dataType)).alias("data_type"),
                "row_count",
                F.col(f"nulls_{i}").alias("null_count"),
                F.round(F.col(f"nulls_{i}") / F.col("row_count") * 100, 2).alias("null_pct"),
                F.col(f"values_{i}").alias("distinct_count"),
                F.round((F.col("row_count") - F.col(f"nulls_{i}")) / F.col("row_count") * 100, 2).alias(
                    "completeness_pct"
                ),
            )
            for i, f in fields
        ]
    )
    return counts.select(F.inline(entries))


def column_sketches(df: DataFrame, table_name: str) -> DataFrame:
    """One row per column: rows, blanks, and a sketch of its distinct values that can be merged with others.

    A single pass with one row per task shuffled; a sketch has a few kilobytes, whatever it has seen. An empty frame has
    no rows. Rows of several parts of a table give the table's profile by ``profile_of_sketches``.
    """
    fields = list(enumerate(df.schema))
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(is_blank(f"`{f.name}`", f.dataType)).alias(f"nulls_{i}") for i, f in fields],
        *[F.hll_sketch_agg(_value_text(f)).alias(f"sketch_{i}") for i, f in fields],
    ).where("row_count > 0")
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(str(f.dataType)).alias("data_type"),
                F.col(f"nulls_{i}").alias("null_count"), F.col(f"sketch_{i}").alias("sketch"),
            )
            for i, f in fields
        ]
    )
    return counts.select(F.lit(table_name).alias("table_name"), "row_count", F.inline(entries))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The profiles of tables whose parts were sketched: counts add up exactly, distinct values are estimated.

    The estimate has a standard error of about 1.6 % (sketches of 2**12 places). Parts are merged by table and column;
    a column that only some parts have counts as NULL in the rows of the others.
    """
    rows = sketches.groupBy("table_name", "column_name").agg(
        F.max("position").alias("position"), F.max_by("data_type", "position").alias("data_type"), F.sum("row_count").alias("seen"),
        F.sum("null_count").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
    )
    parts = sketches.groupBy("table_name", "part").agg(F.max("row_count").alias("n")).groupBy("table_name").agg(F.sum("n").alias("row_count"))
    null_count = F.col("nulls") + F.col("row_count") - F.col("seen")
    complete = (F.col("row_count") - F.col("null_count")) / F.col("row_count") * 100
    return (
        rows.join(parts, "table_name")
        .withColumn("null_count", null_count)
        .select(
            "table_name", "position", "column_name", "data_type", "row_count", "null_count",
            F.round(F.col("null_count") / F.col("row_count") * 100, 2).alias("null_pct"), "distinct_count",
            F.round(complete, 2).alias("completeness_pct"),
        )
    )


def gate_of_profiles(profiles: DataFrame, pass_at: float = 80, quarantine_at: float = 60) -> DataFrame:
    """The rows that ``quality_gate`` gives, from stored profiles (one row per table, as ``table_profile`` makes them)."""
    complete = F.transform(F.map_values("columns"), lambda c: c["completeness_pct"])
    mean = F.aggregate(complete, F.lit(0.0), lambda total, one: total + one) / F.size(complete)
    return profiles.withColumn("completeness", mean).withColumn("quality_score", F.round("completeness", 2)).select(
        "table_name", "row_count", F.col("column_count").cast("bigint").alias("column_count"), "completeness", "quality_score",
        gate_status(F.col("quality_score"), pass_at, quarantine_at).alias("status"),
    )


def quality_gate(
    df: DataFrame, table_name: str, pass_at: float = 80, quarantine_at: float = 60
) -> DataFrame:
    """One row: mean column completeness as score, and PASS / QUARANTINE / REJECT.

    An empty table scores 0 and is rejected.
    """
    fields = list(enumerate(df.schema))
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(is_blank(f"`{f.name}`", f.dataType)).alias(f"nulls_{i}") for i, f in fields],
    )
    complete = [
        F.round(F.try_divide(F.col("row_count") - F.col(f"nulls_{i}"), F.col("row_count")) * 100, 2)
        for i, _ in fields
    ]
    mean = F.aggregate(F.array(*complete), F.lit(0.0), lambda total, one: total + one) / F.lit(len(complete))
    return (
        counts.withColumn("completeness", F.coalesce(mean, F.lit(0.0)))
        .withColumn("quality_score", F.round("completeness", 2))
        .select(
            F.lit(table_name).alias("table_name"),
            "row_count",
            F.lit(len(fields)).cast("bigint").alias("column_count"),
            "completeness",
            "quality_score",
            gate_status(F.col("quality_score"), pass_at, quarantine_at).alias("status"),
        )
    )


def combine_gates(gates: Sequence[DataFrame], pass_at: float = 80, quarantine_at: float = 60) -> DataFrame:
    """Gate of a table built from several sources.

    Rows add up, scores are averaged and the status follows from the average; column
    count and completeness are those of the first source.
    """
    numbered = [g.withColumn("source_no", F.lit(i)) for i, g in enumerate(gates)]
    merged = union_all(numbered).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("source_no", "table_name"))), lambda s: s["table_name"]
            ),
            " + ",
        ).alias("table_name"),
        F.sum("row_count").alias("row_count"),
        F.min_by("column_count", "source_no").alias("column_count"),
        F.min_by("completeness", "source_no").alias("completeness"),
        F.round(F.avg("quality_score"), 2).alias("quality_score"),
    )
    return merged.withColumn("status", gate_status(F.col("quality_score"), pass_at, quarantine_at))


def table_profile(columns: DataFrame, **attributes: Column) -> DataFrame:
    """Fold long column profiles into one row per table, with its columns and schema as maps.

    A group holds one row per column of a table, whatever the size of the data.
    """
    stats = F.struct("data_type", "null_count", "null_pct", "distinct_count", "completeness_pct")
    entry = F.struct("position", "column_name", stats.alias("stats"))
    folded = columns.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).cast("int").alias("column_count"),
        F.round(F.avg("completeness_pct"), 2).alias("output_completeness"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    by_name = lambda value: F.map_from_arrays(
        F.col("entries.column_name"), F.transform("entries", value)
    )
    return folded.select(
        "table_name",
        "row_count",
        "column_count",
        "output_completeness",
        by_name(lambda e: e["stats"]).alias("columns"),
        by_name(lambda e: e["stats"]["data_type"]).alias("schema"),
        *[value.alias(name) for name, value in attributes.items()],
    )


def profile_with_provenance(
    df: DataFrame,
    table_name: str,
    source_score: float | None,
    source_status: str | None,
    steps: Sequence[str],
    sources: Sequence[str],
    plan: str = "batched",
) -> DataFrame:
    """Profile of a refined table together with the gate of its sources and how it was made."""
    quality = F.struct(
        F.lit(source_score).cast("double").alias("source_score"),
        F.lit(source_score).cast("double").alias("overall_score"),
        F.lit(source_status or "UNKNOWN").alias("source_status"),
        F.col("output_completeness").alias("silver_completeness"),
    )
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return table_profile(
        profile_columns(df, table_name, plan=plan),
        quality=quality,
        transformations=texts(steps),
        sources=texts(sources),
    ).drop("output_completeness")
