"""Scores and coverage of the metadata itself.

All functions are projections and one grouped aggregate by layer over the asset table;
every document is parsed once per row and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.dates import first_timestamp, freshness_score
from strata.functions.documents import json_field, json_list, json_object
from strata.functions.numbers import clamp, five_point, share_pct
from strata.functions.predicates import filled
from strata.functions.text import LAYERS, layer_of, layer_tag
from strata.operators.lineage import on_layers

EVALUATED = ("bronze", "silver", "gold")
SCORES = ("completeness", "accuracy", "timeliness", "consistency")


def _score(checks: Sequence[Column]) -> Column:
    """Passed checks in percent, as an integer."""
    passed = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks])
    return F.round(passed / len(checks) * 100).cast("int")


def _doc(section: str, name: str) -> Column:
    return json_field(F.col("_doc")[section], name)


def _has_entries(column: Column) -> Column:
    return F.size(json_object(column)) > 0


def completeness_score(layer: Column) -> Column:
    """Share of required checks: nine for every layer, four more for silver, three more for gold."""
    base = [
        *[filled(c) for c in ("qualified_name", "name", "description", "layer", "format", "location")],
        _has_entries(F.col("schema_def")),
        F.col("row_count").isNotNull(),
        filled("ingested_at") | filled("enriched_at"),
    ]
    silver = [
        filled(_doc("business", "owner")),
        filled(_doc("business", "glossary_terms")),
        _has_entries(F.col("_doc")["quality"]),
        filled(F.col("_doc")["compliance"]),
    ]
    gold = [
        filled(_doc("star_schema", "table_type")) | filled(_doc("kpi", "iku_code")),
        filled(F.col("_doc")["consumption"]),
        filled("enriched_at"),
    ]
    return (
        F.when(layer == "bronze", _score(base))
        .when(layer == "silver", _score(base + silver))
        .otherwise(_score(base + gold))
    )


def accuracy_score(layer: Column) -> Column:
    """Trust in schema and quality: the first rule that applies decides."""
    stated = F.coalesce(
        *[_doc("quality", n).try_cast("double") for n in ("overall_score", "source_score", "score", "quality_score")]
    )
    status = _doc("quality", "source_status")
    in_star = filled(_doc("star_schema", "table_type")) | filled(_doc("kpi", "iku_code"))
    # Points of each rule, in the order of the rules.
    return (
        F.when(~_has_entries(F.col("schema_def")) | F.coalesce(F.col("row_count") < 0, F.lit(False)), 0)
        .when(layer == "bronze", 95)
        .when(stated.isNotNull(), clamp(F.round(stated), 0, 100))
        .when(status == "PASS", 90)
        .when(status == "QUARANTINE", 70)
        .when(layer == "silver", 85)
        .when(in_star, 92)
        .otherwise(75)
        .cast("int")
    )


def timeliness_score(as_of: str) -> Column:
    """Freshness of the last enrichment, else of the ingestion."""
    return freshness_score(first_timestamp("enriched_at", "ingested_at"), as_of)


def consistency_score(layer: Column) -> Column:
    """Agreement of stated layer, derived layer, name prefix, tag and location."""
    name = F.coalesce("qualified_name", F.lit(""))
    return _score(
        [
            F.col("layer") == layer,
            layer_of("layer", name) == layer,
            name.startswith(F.concat(layer, F.lit("."))),
            F.array_contains("classifications", layer_tag(layer)),
            F.lower("location").contains(layer),
        ]
    )


def asset_scores(assets: DataFrame, as_of: str, layers: Sequence[str] = EVALUATED) -> DataFrame:
    """Four scores per asset and layer tag it carries (an asset is judged as what its tag says)."""
    wanted = F.array(*[F.lit(x) for x in layers])
    tagged = F.filter(wanted, lambda x: F.array_contains("classifications", layer_tag(x)))
    judged = F.col("evaluated_layer")
    return (
        assets.withColumn("evaluated_layer", F.explode(tagged))
        .withColumn("_doc", json_object("profiling"))
        .select(
            "qualified_name",
            judged,
            completeness_score(judged).alias("completeness"),
            accuracy_score(judged).alias("accuracy"),
            timeliness_score(as_of).alias("timeliness"),
            consistency_score(judged).alias("consistency"),
        )
    )


def layer_report(scores: DataFrame, layers: Sequence[str] = EVALUATED) -> DataFrame:
    """Mean of each score per layer, rounded, and on the scale 1..5; a layer without assets scores 0 and 1."""
    means = scores.groupBy(F.col("evaluated_layer").alias("layer")).agg(
        F.count(F.lit(1)).alias("entity_count"), *[F.round(F.avg(s)).cast("int").alias(s) for s in SCORES]
    )
    return on_layers(means, layers).select(
        "layer",
        F.initcap("layer").alias("label"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"),
        *[F.coalesce(s, F.lit(0)).alias(s) for s in SCORES],
        *[five_point(F.coalesce(s, F.lit(0))).alias(f"{s}_score_1_5") for s in SCORES],
    )


def coverage(assets: DataFrame, layers: Sequence[str] = EVALUATED) -> DataFrame:
    """Per layer: share of assets with a schema, an owner, a glossary term and a PII tag."""
    described = F.coalesce(~F.col("schema_def").isin("", "{}"), F.lit(False))
    flags = {
        "schema_documented_pct": described,
        "owner_steward_pct": F.coalesce(_doc("business", "owner") != "", F.lit(False)),
        "glossary_term_pct": F.size(json_list(_doc("business", "glossary_terms"))) > 0,
        "classification_pii_pct": F.coalesce(F.array_contains("classifications", "PII"), F.lit(False)),
    }
    per_layer = (
        assets.withColumn("_doc", json_object("profiling"))
        .select(layer_of("layer", "qualified_name").alias("layer"), *[f.alias(n) for n, f in flags.items()])
        .groupBy("layer")
        .agg(
            F.count(F.lit(1)).alias("entity_count"),
            *[share_pct(F.count_if(n), F.count(F.lit(1))).alias(n) for n in flags],
        )
    )
    return on_layers(per_layer, layers).select(
        "layer",
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"),
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in flags],
    )


def count_by_layer(assets: DataFrame, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Assets per layer, also for layers without any."""
    counted = (
        assets.groupBy(layer_of("layer", "qualified_name").alias("layer")).agg(F.count(F.lit(1)).alias("assets"))
    )
    return on_layers(counted, layers).select("layer", F.coalesce("assets", F.lit(0)).alias("assets"))


def count_by_tag(assets: DataFrame) -> DataFrame:
    """Assets per classification; an asset with several tags counts once for each."""
    return (
        assets.select(F.explode(F.array_distinct("classifications")).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("assets"))
    )


def registration_snapshot(assets: DataFrame, processes: DataFrame, layer: str, as_of: str) -> DataFrame:
    """One row after registering a layer: datasets, processes and datasets tagged with the layer."""
    tag = layer_tag(F.lit(layer))
    return assets.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if(F.array_contains("classifications", tag)).alias("classified"),
    ).select(
        F.lit(layer).alias("layer"),
        F.lit(as_of).alias("generated_at"),
        "datasets",
        processes.select(F.count(F.lit(1))).scalar().alias("processes"),
        "classified",
    )


def pass_rate(assets: DataFrame) -> DataFrame:
    """Share of passed among passed and quarantined assets; 0 without any."""
    tagged = lambda t: F.count_if(F.coalesce(F.array_contains("classifications", t), F.lit(False)))
    counted = assets.agg(tagged("Quality_Pass").alias("passed"), tagged("Quality_Quarantine").alias("quarantined"))
    rate = F.round(F.try_divide(F.col("passed"), F.col("passed") + F.col("quarantined")) * 100)
    return counted.withColumn("pass_pct", F.coalesce(rate, F.lit(0.0)).cast("int"))
