"""Raw tables to clean, enriched tables.

Scale notes
-----------
* ``dedup`` and ``latest_valid`` keep row 1 of a window. Spark turns the filter on the
  row number into a group limit that runs before the shuffle, so a task sends one row
  per key and a key holding a third of the table does not meet in one task.
* Lookups keep the big side in place: the lookup side is reduced to one row per key,
  Spark broadcasts it only if it is below ``autoBroadcastJoinThreshold``, and otherwise
  the adaptive skew join splits a hot key of the big side. Rows are deduplicated first,
  so that the join is not followed by another shuffle on a different key.
* Activities are counted per key before they are joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, StructField
from pyspark.sql.window import Window

from strata.functions.predicates import any_of, still_valid
from strata.functions.text import label


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name of many frames, pairwise, so that the plan stays flat."""
    frames = list(parts)
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def _sortable(field: StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return F.to_json(column) if isinstance(field.dataType, MapType) else column


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, by default by all other columns ascending.

    The default needs every column. Name the columns that matter, so that the scan can leave
    out the others; with an empty ``order`` any row of a key may survive.
    """
    rest = [f for f in df.schema if f.name not in keys]
    by = order if order is not None else [_sortable(f) for f in rest]
    if not by:
        return df.dropDuplicates(list(keys))
    window = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def conform(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed view of an all-string table; what cannot be read in the type becomes NULL."""
    return df.withColumns({name: F.col(name).try_cast(type_) for name, type_ in types.items()})


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that adds ``columns`` of ``dim`` and never multiplies rows."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(dedup(dim.select(*keys, *columns), keys), keys, "left")


def enrich_lookup(
    df: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    dim_columns: Sequence[str],
    labels: Mapping[str, tuple[str, Mapping]],
    flags: Mapping[str, Column],
    key: str,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One row per ``key`` with looked-up columns, code labels and flags.

    ``labels`` maps a new column to (code column, code -> label).
    """
    enriched = lookup(dedup(df, [key], order), dim, on, dim_columns)
    enriched = enriched.withColumns({name: label(code, names) for name, (code, names) in labels.items()})
    return enriched.withColumns(dict(flags))


def status_flags(
    df: DataFrame,
    column: str,
    flags: Mapping[str, str],
    any_flag: str,
    key: str,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One boolean per status value and their OR; a NULL status leaves all of them NULL."""
    flagged = dedup(df, [key], order).withColumns({f: F.col(column) == v for f, v in flags.items()})
    return flagged.withColumn(any_flag, any_of(flags))


def activity_flag(
    df: DataFrame,
    activity: DataFrame,
    key: str,
    kind: str,
    flag: str,
    min_kinds: int = 1,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Flag the entities with at least ``min_kinds`` kinds of activity; without any it is false."""
    kinds = activity.groupBy(key).agg(F.count_distinct(kind).alias("_kinds"))
    return (
        dedup(df, [key], order)
        .join(kinds, key, "left")
        .withColumn(flag, F.coalesce("_kinds", F.lit(0)) >= min_kinds)
        .drop("_kinds")
    )


def union_normalise(
    parts: Sequence[tuple[DataFrame, Mapping[str, str | Column], str]],
    kind: str,
    key: str,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Bring sources to the same columns, mark each with its kind, union them, one row per key."""
    shaped = [
        df.select(
            *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()],
            F.lit(kind_value).alias(kind),
        )
        for df, columns, kind_value in parts
    ]
    return dedup(union_all(shaped), [key], order)


def filter_flag(
    df: DataFrame,
    predicate: Column,
    flag: str,
    column: str,
    values: Sequence,
    key: str,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Rows passing ``predicate``, one per key, flagged by membership of ``column`` in ``values``."""
    kept = dedup(df.where(predicate), [key], order)
    return kept.withColumn(flag, F.col(column).isin(*values))


def latest_valid(
    df: DataFrame,
    key: str | Sequence[str],
    order_column: str,
    end_column: str | None,
    as_of: str | None,
    tiebreak: Sequence[str],
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Newest row per key among those still valid on ``as_of``; a key without any is absent."""
    keys = [key] if isinstance(key, str) else list(key)
    valid = df if end_column is None else df.where(still_valid(end_column, as_of))
    latest = dedup(valid, keys, [F.col(order_column).desc(), *tiebreak])
    return latest.withColumns(dict(flags)) if flags else latest
