"""JSON documents held in string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def json_object(column: Column | str) -> Column:
    """JSON object as map of texts; anything else (bad text, array, NULL) gives an empty map."""
    parsed = F.from_json(_col(column), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def json_field(column: Column | str, path: str, default: str | None = None) -> Column:
    """Text of one field, e.g. ``quality.status``; JSON null and a missing field give the default."""
    found = F.get_json_object(_col(column), f"$.{path}")
    return found if default is None else F.coalesce(found, F.lit(default))


def json_number(column: Column | str, path: str) -> Column:
    """Numeric field; NULL when it does not read as a number."""
    return json_field(column, path).try_cast("double")


def json_list(column: Column | str) -> Column:
    """JSON array of texts; anything else gives an empty array."""
    parsed = F.from_json(_col(column), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def json_list_field(column: Column | str, path: str) -> Column:
    """Array field of a document, empty when missing."""
    return json_list(json_field(column, path))


def non_empty_texts(column: Column) -> Column:
    """Texts of an array that are neither NULL nor empty."""
    return F.filter(column, lambda x: x.isNotNull() & (x != ""))


def column_stats(profiling: Column | str) -> Column:
    """Column profiles of both document shapes: under ``columns`` or at the root.

    A root counts only when its entries look like column profiles.
    """
    doc = _col(profiling)
    nested = F.get_json_object(doc, "$.columns")
    stat = "struct<data_type:string,null_count:bigint,null_pct:double,distinct_count:bigint,completeness_pct:double>"
    as_map = F.from_json(F.coalesce(nested, doc), f"map<string,{stat}>")
    looks_right = lambda _, s: (
        s["null_count"].isNotNull() | s["null_pct"].isNotNull() | s["completeness_pct"].isNotNull()
    )
    kept = F.when(nested.isNotNull(), as_map).otherwise(F.map_filter(as_map, looks_right))
    return F.coalesce(kept, F.create_map().cast(f"map<string,{stat}>"))
