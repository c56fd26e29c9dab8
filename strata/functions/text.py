"""Names, labels and layer prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# The layers of the lakehouse, in refinement order.
LAYERS = ("staging", "bronze", "silver", "gold")
LAYER_ORDER = (*LAYERS, "unknown")

# Type names of the two kinds of catalog entries.
DATASET = "lakehouse_dataset"
PROCESS = "lakehouse_etl_process"


def label(code: Column | str, mapping: Mapping) -> Column:
    """Code -> label through a literal map; a code without label gives NULL."""
    c = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.create_map(*pairs)[c]


def layer_from_name(qualified_name: Column | str, prefixes: Iterable[str] = LAYERS) -> Column:
    """Layer prefix of ``layer.table@cluster``, or 'unknown'."""
    c = F.col(qualified_name) if isinstance(qualified_name, str) else qualified_name
    found = F.regexp_extract(c, rf"^({'|'.join(prefixes)})\.", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def layer_of(layer: Column | str, qualified_name: Column | str) -> Column:
    """The asset's own layer when it states one, else the prefix of its name."""
    own = F.col(layer) if isinstance(layer, str) else layer
    return F.coalesce(F.nullif(own, F.lit("")), layer_from_name(qualified_name))


def qualified_name(layer: Column | str, table: Column | str, cluster: str) -> Column:
    """``layer.table@cluster``; both parts may be a literal layer or a column."""
    first = F.lit(layer) if isinstance(layer, str) else layer
    second = F.col(table) if isinstance(table, str) else table
    return F.concat(first, F.lit("."), second, F.lit(f"@{cluster}"))


def process_name(pipeline: str, table: Column | str, cluster: str) -> Column:
    """``etl.pipeline.table@cluster``."""
    return qualified_name(f"etl.{pipeline}", table, cluster)


def layer_tag(layer: Column | str) -> Column:
    """'silver' -> 'Silver_Layer'."""
    c = F.col(layer) if isinstance(layer, str) else layer
    return F.concat(F.initcap(c), F.lit("_Layer"))


def layer_rank(layer: Column | str) -> Column:
    """Position in refinement order; layers outside it sort last."""
    c = F.col(layer) if isinstance(layer, str) else layer
    position = F.array_position(F.array(*[F.lit(x) for x in LAYER_ORDER]), c)
    return F.when(position > 0, position - 1).otherwise(F.lit(99)).cast("int")


def contains_text(haystack: Column | str, needle: str) -> Column:
    """Case-insensitive substring test."""
    c = F.col(haystack) if isinstance(haystack, str) else haystack
    return F.lower(c).contains(needle.lower())
