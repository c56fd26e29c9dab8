"""The catalog as tables: assets, upserts, the unified metadata table, search and paging.

An asset row carries its documents (``schema_def``, ``profiling``, ``pii_columns``) as
JSON text, because they differ by layer and may come from elsewhere; readers parse them
with ``strata.functions.documents``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from strata.functions.documents import json_field, json_list, json_list_field, json_object, non_empty_texts
from strata.functions.text import DATASET, contains_text, layer_of, layer_rank, layer_tag, qualified_name
from strata.operators.dims import literal_table
from strata.operators.refine import dedup
from strata.sources.scratch import ensure_checkpoint_dir

ASSET_COLUMNS = (
    "qualified_name", "name", "type_name", "layer", "format", "location", "description",
    "row_count", "column_count", "schema_def", "profiling", "pii_columns", "classifications",
    "ingested_at", "enriched_at",
)


def _assets(tables: DataFrame, **values: Column) -> DataFrame:
    missing = F.lit(None)
    types = {"row_count": "bigint", "column_count": "int", "classifications": "array<string>"}
    return tables.select(
        *[values.get(c, missing).cast(types.get(c, "string")).alias(c) for c in ASSET_COLUMNS]
    )


def _tags(*tags: Column) -> Column:
    return F.array_compact(F.array(*tags))


def staging_assets(tables: DataFrame, cluster: str, landing: str) -> DataFrame:
    """Assets of raw files; ``tables`` has ``table_name``."""
    name = F.col("table_name")
    return _assets(
        tables,
        qualified_name=qualified_name("staging", name, cluster),
        name=name,
        type_name=F.lit(DATASET),
        layer=F.lit("staging"),
        format=F.lit("csv"),
        location=F.concat(F.lit(f"{landing}/"), name, F.lit(".csv")),
        description=F.concat(F.lit("Raw source file: "), name, F.lit(".csv")),
        classifications=_tags(layer_tag(F.lit("staging"))),
    )


def bronze_assets(
    profiles: DataFrame, cluster: str, warehouse: str, as_of: str, table_format: str = "parquet"
) -> DataFrame:
    """Assets of raw tables, tagged PII iff they list PII columns.

    ``profiles`` comes from ``table_profile`` and has an array ``pii_columns``.
    """
    name = F.col("table_name")
    has_pii = F.size("pii_columns") > 0
    return _assets(
        profiles,
        qualified_name=qualified_name("bronze", name, cluster),
        name=F.concat(F.lit("bronze_"), name),
        type_name=F.lit(DATASET),
        layer=F.lit("bronze"),
        format=F.lit(table_format),
        location=F.concat(F.lit(f"{warehouse}/bronze/"), name),
        description=F.concat(F.lit("Raw table in bronze layer: "), name),
        row_count=F.col("row_count"),
        column_count=F.col("column_count"),
        schema_def=F.to_json("schema"),
        profiling=F.to_json("columns"),
        pii_columns=F.to_json("pii_columns"),
        classifications=_tags(layer_tag(F.lit("bronze")), F.when(has_pii, F.lit("PII"))),
        ingested_at=F.lit(as_of),
    )


def silver_assets(
    profiles: DataFrame,
    business: DataFrame,
    compliance: DataFrame,
    cluster: str,
    warehouse: str,
    as_of: str,
    table_format: str = "parquet",
) -> DataFrame:
    """Assets of refined tables with quality, business and compliance documents.

    ``profiles`` comes from ``profile_with_provenance`` plus ``written``; tables that were
    not written get no asset. ``business`` and ``compliance`` are keyed by ``table_name``.
    """
    name = F.col("table_name")
    status = F.col("quality.source_status")
    joined = (
        written_only(profiles)
        .join(business, "table_name", "left")
        .join(compliance, "table_name", "left")
    )
    document = F.struct(
        "columns",
        "quality",
        F.struct(
            F.coalesce("business_owner", F.lit("")).alias("owner"),
            _list("iku_relevance"),
            _list("glossary_terms"),
            F.coalesce("update_frequency", F.lit("")).alias("update_frequency"),
        ).alias("business"),
        F.struct(
            "contains_pii", _list("pii_columns"), "data_classification", "retention_policy", "access_restriction"
        ).alias("compliance"),
        "transformations",
    )
    quality_tag = F.when(status == "PASS", F.lit("Quality_Pass")).when(
        status == "QUARANTINE", F.lit("Quality_Quarantine")
    )
    return _assets(
        joined,
        qualified_name=qualified_name("silver", name, cluster),
        name=name,
        type_name=F.lit(DATASET),
        layer=F.lit("silver"),
        format=F.lit(table_format),
        location=F.concat(F.lit(f"{warehouse}/silver/"), name),
        description=F.coalesce("business_description", F.concat(F.lit("Silver table: "), name)),
        row_count=F.col("row_count"),
        column_count=F.col("column_count"),
        schema_def=F.to_json("schema"),
        profiling=F.to_json(document),
        pii_columns=F.to_json(_list("pii_columns")),
        classifications=_tags(
            layer_tag(F.lit("silver")), quality_tag, F.when(F.col("contains_pii"), F.lit("PII"))
        ),
        ingested_at=F.lit(as_of),
        enriched_at=F.lit(as_of),
    )


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>")).alias(column)


def gold_assets(
    profiles: DataFrame,
    kpis: DataFrame,
    consumption: DataFrame,
    cluster: str,
    warehouse: str,
    as_of: str,
    table_format: str = "parquet",
) -> DataFrame:
    """Assets of star-schema tables with schema, KPI, consumption and model-readiness documents.

    ``profiles`` comes from ``gold_profile`` plus ``written``; ``kpis`` holds ``code, name,
    fact_table, formula, unit, plan, panel``; ``consumption`` holds ``table_name, consumers,
    olap_role``.
    """
    name = F.col("table_name")
    is_fact = F.col("table_type") != "dimension"
    has_kpi = F.col("kpi_code").isNotNull()
    by_table = kpis.select(
        F.col("fact_table").alias("table_name"),
        F.col("code").alias("kpi_code"),
        F.col("name").alias("kpi_name"),
        "formula",
        "unit",
        "plan",
        "panel",
    )
    joined = (
        written_only(profiles)
        .join(by_table, "table_name", "left")
        .join(consumption, "table_name", "left")
    )
    models = F.array(F.lit("trend_analysis"), F.lit("anomaly_detection"))
    document = F.struct(
        "schema",
        F.struct("table_type", F.coalesce("olap_role", F.lit("")).alias("olap_role")).alias("star_schema"),
        F.when(
            has_kpi,
            F.struct(
                F.col("kpi_code").alias("iku_code"),
                F.col("kpi_name").alias("iku_nama"),
                "formula",
                F.col("unit").alias("satuan"),
                F.col("plan").alias("sumber_renstra"),
                F.col("sample_kpi.value").alias("nilai_capaian"),
                F.col("sample_kpi.target").alias("nilai_target"),
                F.coalesce("sample_kpi.status", F.lit("")).alias("status_capaian"),
                F.col("sample_kpi.attainment").alias("persen_capaian_terhadap_target"),
            ),
        ).alias("kpi"),
        F.struct(
            _list("consumers"), F.coalesce("panel", F.lit("")).alias("dashboard_panel")
        ).alias("consumption"),
        F.struct(
            is_fact.alias("ml_ready"),
            (is_fact & has_kpi).alias("feature_store_candidate"),
            F.when(has_kpi, models).otherwise(F.array().cast("array<string>")).alias("suggested_models"),
        ).alias("ai_metadata"),
    )
    plain = F.concat(F.lit("Gold "), F.col("table_type"), F.lit(": "), name)
    described = F.concat("kpi_code", F.lit(": "), "kpi_name", F.lit(" — Formula: "), "formula")
    fact_tags = [F.when(is_fact, F.lit(t)) for t in ("Star_Schema_Fact", "KPI_Metric", "Executive_Dashboard")]
    return _assets(
        joined,
        qualified_name=qualified_name("gold", name, cluster),
        name=name,
        type_name=F.lit(DATASET),
        layer=F.lit("gold"),
        format=F.lit(table_format),
        location=F.concat(F.lit(f"{warehouse}/gold/"), name),
        description=F.coalesce(described, plain),
        row_count=F.col("row_count"),
        column_count=F.col("column_count"),
        schema_def=F.to_json("schema"),
        profiling=F.to_json(document),
        pii_columns=F.lit("[]"),
        classifications=_tags(
            layer_tag(F.lit("gold")), F.when(~is_fact, F.lit("Star_Schema_Dimension")), *fact_tags
        ),
        ingested_at=F.lit(as_of),
        enriched_at=F.lit(as_of),
    )


def written_only(profiles: DataFrame) -> DataFrame:
    """Tables that were written; rejected and failed ones are not registered."""
    return profiles.where("written")


def with_pii_columns(profiles: DataFrame, listed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Table profiles with the listed PII columns that the table really has; empty for unlisted tables."""
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    own = F.create_map(*[x for table, names in listed.items() for x in (F.lit(table), texts(names))])
    present = F.array_intersect(F.map_keys("schema"), own[F.col("table_name")])
    return profiles.withColumn("pii_columns", F.coalesce(present, texts([])))


def upsert(current: DataFrame, changes: DataFrame, version: str, key: str = "qualified_name") -> DataFrame:
    """Current and changed rows merged by key; the highest version wins, a change wins a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return dedup(both, [key], [F.col(version).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def unified_metadata(assets: DataFrame) -> DataFrame:
    """Technical, business and operational document of every asset, and when it was last enriched.

    Fields of the profiling document that are documents themselves stay JSON text.
    """
    layer = layer_of("layer", "qualified_name")
    stamp = lambda c: F.nullif(F.col(c), F.lit(""))
    known = layer.isin("staging", "bronze", "silver", "gold")
    doc = F.col("_doc")
    owner = lambda name: json_field(doc["business"], name)
    return assets.withColumn("_doc", json_object("profiling")).select(
        F.col("qualified_name").alias("asset_qualified_name"),
        layer.alias("layer"),
        F.struct(
            json_object("schema_def").alias("schema"),
            "format",
            "location",
            "row_count",
            "column_count",
            json_list("pii_columns").alias("pii_columns"),
        ).alias("technical"),
        F.struct(
            "description",
            owner("owner").alias("owner"),
            owner("domain").alias("domain"),
            json_list(owner("glossary_terms")).alias("glossary_terms"),
            json_list(owner("iku_relevance")).alias("iku_relevance"),
            owner("update_frequency").alias("update_frequency"),
            doc["kpi"].alias("kpi"),
            doc["consumption"].alias("consumption"),
            doc["ai_metadata"].alias("ai_metadata"),
        ).alias("business"),
        F.struct(
            F.coalesce("classifications", F.array().cast("array<string>")).alias("classifications"),
            doc["quality"].alias("quality"),
            doc["compliance"].alias("compliance"),
            doc["star_schema"].alias("star_schema"),
            doc["transformations"].alias("transformations"),
        ).alias("operational"),
        F.coalesce(stamp("enriched_at"), F.when(known, stamp("ingested_at"))).alias("last_enriched_at"),
    )


def in_layer_order(umt: DataFrame) -> DataFrame:
    """Refinement order of the layers, then name; a distributed range sort."""
    return umt.orderBy(layer_rank("layer"), "asset_qualified_name")


def layer_places(umt: DataFrame, name: str = "place") -> DataFrame:
    """The table with every row's place in ``in_layer_order``."""
    return placed(umt, [layer_rank("layer"), "asset_qualified_name"], name)


def in_layer(umt: DataFrame, layer: str | None) -> DataFrame:
    """Rows of one layer, or all."""
    return umt if layer is None else umt.where(F.col("layer") == layer)


def umt_documents(umt: DataFrame) -> DataFrame:
    """The unified metadata table with its three documents as JSON text, ready for export."""
    return umt.select(
        "asset_qualified_name",
        "layer",
        *[F.to_json(c).alias(f"{c}_json") for c in ("technical", "business", "operational")],
        "last_enriched_at",
    )


def search(
    assets: DataFrame,
    type_name: str | None = None,
    query: str | None = None,
    classification: str | None = None,
) -> DataFrame:
    """Assets of a type whose name, qualified name or description contains a text and that carry a tag."""
    found = assets
    if type_name is not None:
        found = found.where(F.col("type_name") == type_name)
    if query:
        hits = [F.coalesce(contains_text(c, query), F.lit(False)) for c in ("name", "qualified_name", "description")]
        found = found.where(hits[0] | hits[1] | hits[2])
    if classification:
        found = found.where(F.array_contains("classifications", classification))
    return found


_ROW_BITS = 33  # of the numbers that monotonically_increasing_id gives: partition above, row below


def placed(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of every row in a total order, whatever its size.

    The rows are sorted by ranges of the order, which split a hot value of the first key by the others, and written to
    the shared folder. A row's place is its number within its range and the counts of the ranges before; only these
    counts, a row per range, are summed in one task.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.orderBy(*order).checkpoint().withColumn("_row", F.monotonically_increasing_id())
    numbered = rows.withColumn("_range", F.shiftright("_row", _ROW_BITS).cast("int"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return numbered.join(F.broadcast(bases), "_range").select(*df.columns, (F.col("_base") + within + 1).alias(name))


# Beyond so many rows before its end a page is found by counts per range.
DEEP = 100_000


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0, deep: int = DEEP) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` in a total order.

    Up to ``deep`` rows each task keeps only its best offset + limit. A deeper page is cut out of the rows' places
    (``placed``), so no task holds what comes before it; whoever walks from page to page should use ``page_after``.
    """
    if offset + limit <= deep:
        return df.orderBy(*order).offset(offset).limit(limit)
    wanted = placed(df, order, "_place").where(F.col("_place").between(offset + 1, offset + limit))
    return wanted.orderBy("_place").drop("_place")


def page_after(df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence, limit: int) -> DataFrame:
    """The ``limit`` rows after the row with the key values ``last``; costs the same on any page.

    ``keys`` are columns and whether they descend; together they are a total order. NULLs come first when ascending and
    last when descending, as in ``orderBy``.
    """
    after, equal = F.lit(False), F.lit(True)
    for (name, descends), value in zip(keys, last):
        column = F.col(name)
        if value is None:
            beyond = F.lit(False) if descends else column.isNotNull()
        elif descends:
            beyond = (column < F.lit(value)) | column.isNull()
        else:
            beyond = column > F.lit(value)
        after = after | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    return df.where(after).orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in keys]).limit(limit)


def page_number(df: DataFrame, order: Sequence[str | Column], number: int, per_page: int) -> DataFrame:
    """Page ``number``, counted from 1."""
    return page(df, order, per_page, (number - 1) * per_page)


def first_match(df: DataFrame, predicate: Column, order: Sequence[str | Column]) -> DataFrame:
    """The first row in ``order`` that passes ``predicate``; no row if none does."""
    return page(df.where(predicate), order, 1)


def by_qualified_name(assets: DataFrame, name: str) -> DataFrame:
    """The asset with exactly this name; the equality reaches the scan."""
    return assets.where(F.col("qualified_name") == name)


def sort_by(df: DataFrame, column: str, ascending: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sort by a chosen column in either direction."""
    first = F.col(column).asc() if ascending else F.col(column).desc()
    return df.orderBy(first, *tiebreak)


def merge_by_key(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of lists with one row per key; the last list that has the key wins."""
    merged = None
    for i, rows in enumerate(lists):
        ranked = rows.where(F.col(key).isNotNull()).withColumn("_list", F.lit(i))
        merged = ranked if merged is None else merged.unionByName(ranked)
    rest = [c for c in merged.columns if c not in (key, "_list")]
    return dedup(merged, [key], [F.col("_list").desc(), *rest]).drop("_list")


def quality_meta(assets: DataFrame) -> DataFrame:
    """Quality document in one shape: score and status with their fallbacks; NULL when it says nothing."""
    field = lambda name: json_field("profiling", f"quality.{name}")
    status = lambda name: F.nullif(field(name), F.lit(""))
    score = F.coalesce(
        *[field(n).try_cast("double") for n in ("quality_score", "source_score", "overall_score", "silver_completeness")]
    )
    says = (
        field("quality_score").isNotNull()
        | field("source_score").isNotNull()
        | status("source_status").isNotNull()
        | status("status").isNotNull()
    )
    shown = F.coalesce(status("status"), status("source_status"), F.lit("UNKNOWN"))
    return assets.select(
        "qualified_name", F.when(says, score).alias("quality_score"), F.when(says, shown).alias("quality_status")
    )


def business_meta(assets: DataFrame) -> DataFrame:
    """Business document in one shape; ``has_business`` is false when it says nothing."""
    owner = F.nullif(json_field("profiling", "business.owner"), F.lit(""))
    frequency = F.nullif(json_field("profiling", "business.update_frequency"), F.lit(""))
    terms = json_list_field("profiling", "business.glossary_terms")
    relevance = json_list_field("profiling", "business.iku_relevance")
    says = owner.isNotNull() | frequency.isNotNull() | (F.size(terms) > 0) | (F.size(relevance) > 0)
    return assets.select(
        "qualified_name",
        says.alias("has_business"),
        owner.alias("owner"),
        frequency.alias("update_frequency"),
        terms.alias("glossary_terms"),
        relevance.alias("iku_relevance"),
    )


def compliance_meta(assets: DataFrame) -> DataFrame:
    """Compliance document, completed from the asset's own PII column list."""
    own = json_list("pii_columns")
    has_own = F.size(own) > 0
    stated = json_list_field("profiling", "compliance.pii_columns")
    flag = json_field("profiling", "compliance.contains_pii").try_cast("boolean")
    contains = F.coalesce(flag, F.when(has_own, F.lit(True)))
    columns = F.when(F.size(stated) > 0, stated).otherwise(own)
    classification = F.nullif(json_field("profiling", "compliance.data_classification"), F.lit(""))
    says = contains.isNotNull() | classification.isNotNull() | (F.size(columns) > 0)
    return assets.select(
        "qualified_name",
        says.alias("has_compliance"),
        contains.alias("contains_pii"),
        columns.alias("pii_columns"),
        classification.alias("data_classification"),
        json_field("profiling", "compliance.retention_policy").alias("retention_policy"),
    )


def transformations(assets: DataFrame) -> DataFrame:
    """Steps an asset was made with, without empty entries."""
    steps = non_empty_texts(json_list_field("profiling", "transformations"))
    return assets.select("qualified_name", steps.alias("transformations"))


def lifecycle(assets: DataFrame) -> DataFrame:
    """Lifecycle stage of an asset by layer and quality tag, and the zone of the stage."""
    tags = F.coalesce("classifications", F.array().cast("array<string>"))
    checked = F.arrays_overlap(tags, F.array(F.lit("Quality_Pass"), F.lit("Quality_Quarantine")))
    layer = layer_of("layer", "qualified_name")
    # Stage numbers by layer, and the last stage of each zone.
    stage = (
        F.when(layer == "gold", 13)
        .when(layer == "silver", 10)
        .when((layer == "bronze") & checked, 9)
        .when(layer == "bronze", 7)
        .when(layer == "staging", 4)
        .otherwise(3)
    )
    zone = (
        F.when(stage <= 4, "Sandbox").when(stage <= 9, "Enrichment").when(stage <= 13, "Production").otherwise("Evolution")
    )
    return assets.select("qualified_name", layer.alias("layer"), stage.alias("stage"), zone.alias("zone"))


def static_attributes(spark: SparkSession, attributes: Mapping[str, Mapping], schema: StructType) -> DataFrame:
    """Per-table attributes written in code as a table keyed by ``table_name``."""
    names = [f.name for f in schema][1:]
    rows = [(table, *[values.get(n) for n in names]) for table, values in attributes.items()]
    return literal_table(spark, rows, schema)
