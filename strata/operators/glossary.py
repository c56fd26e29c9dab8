"""Business glossary collected from the catalog.

A term may be used by a large part of all assets, so the assets of a term are kept as
rows (``term_links``), not as an array in the term's row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strata.functions.documents import json_field, json_list, json_object
from strata.functions.text import layer_of
from strata.operators.dims import literal_table
from strata.operators.refine import dedup

DICTIONARY_SCHEMA = StructType([StructField(c, StringType()) for c in ("term", "definition", "category")])


def dictionary(spark: SparkSession, terms: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Known terms: term -> (definition, category)."""
    return literal_table(spark, [(t, d, c) for t, (d, c) in terms.items()], DICTIONARY_SCHEMA)


def _links(assets: DataFrame) -> DataFrame:
    doc = F.col("_doc")
    parsed = assets.select(
        "qualified_name",
        layer_of("layer", "qualified_name").alias("layer"),
        json_object("profiling").alias("_doc"),
    )
    business = parsed.select(
        F.explode(F.array_distinct(json_list(json_field(doc["business"], "glossary_terms")))).alias("term"),
        F.lit("silver_metadata").alias("source"),
        "qualified_name",
        F.lit(None).cast("string").alias("stated_definition"),
    )
    code = F.nullif(json_field(doc["kpi"], "iku_code"), F.lit(""))
    name = F.nullif(json_field(doc["kpi"], "iku_nama"), F.lit(""))
    kpis = parsed.where((F.col("layer") == "gold") & code.isNotNull()).select(
        code.alias("term"),
        F.lit("gold_metadata").alias("source"),
        "qualified_name",
        F.coalesce(name, code).alias("stated_definition"),
    )
    return business.where("term is not null").unionByName(kpis)


def term_links(assets: DataFrame) -> DataFrame:
    """Distinct (term, source, asset): business terms of any asset, and KPI codes of gold assets.

    A KPI row also brings the KPI's name as its definition.
    """
    return _links(assets).distinct()


def glossary_terms(assets: DataFrame, known: DataFrame, default_definition: str) -> DataFrame:
    """One row per term: definition, category, source and how many assets use it.

    Business terms are defined by ``known``, else by ``default_definition`` plus the term.
    A KPI code replaces a business term of the same text.
    """
    counted = (
        _links(assets)
        .groupBy("term", "source")
        .agg(
            F.count_distinct("qualified_name").alias("related_assets"),
            F.min("stated_definition").alias("stated_definition"),
        )
    )
    winner = dedup(counted, ["term"], [F.col("source").asc()])
    defined = winner.join(known, "term", "left")
    is_kpi = F.col("source") == "gold_metadata"
    fallback = F.concat(F.lit(default_definition), "term")
    return defined.select(
        "term",
        F.when(is_kpi, F.col("stated_definition")).otherwise(F.coalesce("definition", fallback)).alias("definition"),
        F.when(is_kpi, F.lit("Business")).otherwise(F.coalesce("category", F.lit("Business"))).alias("category"),
        "source",
        "related_assets",
    )


def merge_glossary(catalog: DataFrame, metadata: DataFrame, local: DataFrame) -> DataFrame:
    """Terms of three sources merged without regard to case: catalog before metadata before local."""
    shape = ["term", "definition", "category"]
    parts = [
        catalog.select(*shape, F.lit("catalog").alias("source"), F.lit(0).alias("_rank")),
        metadata.select(*shape, "source", F.lit(1).alias("_rank")),
        local.select(*shape, F.lit("local").alias("source"), F.lit(2).alias("_rank")),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_key", F.lower("term"))
    return dedup(merged, ["_key"], ["_rank", "term", "definition", "category", "source"]).drop("_key", "_rank")


def categories(terms: DataFrame) -> DataFrame:
    """Distinct categories, sorted."""
    return terms.select("category").distinct().orderBy("category")
