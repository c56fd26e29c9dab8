"""Catalog queries: one asset per document, derived from documents and labels.

The assets are uneven on purpose: layers, documents and dates are missing, blank or
malformed depending on language, source, length and label of the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strata.functions.documents import json_field, json_list, json_object
from strata.functions.predicates import filled
from strata.functions.text import DATASET
from strata.operators import catalog, glossary, governance, kpi, profile
from strata.operators.refine import union_all
from strata.queries import query, table
from strata.queries.refinement import orders_with_flags

AS_OF = "2024-07-01T00:00:00Z"
LAYER_BY_LANG = {"fr": "staging", "de": "bronze", "en": "silver", "es": "gold"}

BRONZE_DOC = (
    '{"text":{"data_type":"StringType()","null_count":0,"null_pct":0.0,"distinct_count":1,"completeness_pct":100.0}}'
)

ASSETS = f"""assets AS (
    SELECT doc_id, prefix || '.doc_' || doc_id || '@lake' AS qualified_name,
           CASE WHEN source = 'src3' THEN '' ELSE 'doc_' || doc_id END AS name, '{DATASET}' AS type_name,
           CASE WHEN prefix <> 'tmp' AND quality IS DISTINCT FROM 0 THEN home END AS layer,
           CASE WHEN source <> 'src5' THEN 'parquet' END AS format,
           CASE WHEN source = 'src7' THEN 's3a://Landing/' ELSE 's3a://warehouse/' || home || '/' END || source AS location,
           CASE WHEN toxic IS DISTINCT FROM 1 THEN 'Text in ' || lang || ' from ' || source END AS description,
           CASE source WHEN 'src9' THEN NULL WHEN 'src11' THEN -1 ELSE n_chars END AS row_count,
           5 AS column_count,
           CASE source WHEN 'src2' THEN '{{}}' WHEN 'src4' THEN 'zzz'
                ELSE '{{"doc_id":"LongType()","text":"StringType()"}}' END AS schema_def,
           CASE home WHEN 'bronze' THEN '{BRONZE_DOC}'
                WHEN 'silver' THEN '{{"columns":' || '{BRONZE_DOC}' || ',"quality":' || quality_doc
                     || ',"business":{{"owner":"' || CASE WHEN source < 'src2' THEN source ELSE '' END
                     || '","iku_relevance":[],"glossary_terms":' || terms_doc || ',"update_frequency":"Yearly"}}'
                     || CASE WHEN n_chars > 500 THEN ',"compliance":{{"contains_pii":' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END
                     || ',"data_classification":"Internal","retention_policy":"7 years"}}' ELSE '' END
                     || ',"transformations":["DEDUP on doc_id","","FLAG toxic"]}}'
                WHEN 'gold' THEN CASE WHEN n_chars > 1500 THEN '{{"star_schema":{{"table_type":"fact"}},"kpi":{{"iku_code":"IKU-'
                     || CAST(n_chars // 1500 AS VARCHAR) || '","iku_nama":"Text length class ' || CAST(n_chars // 1500 AS VARCHAR)
                     || '"}},"consumption":{{"consumers":["board"]}}}}'
                     WHEN n_chars > 300 THEN '{{"star_schema":{{"table_type":"dimension"}},"quality":{{"source_status":"PASS"}}}}'
                     ELSE '[1]' END
           END AS profiling,
           CASE WHEN toxic = 1 THEN '["text"]' ELSE '[]' END AS pii_columns,
           list_filter([CASE WHEN n_chars >= 60 THEN upper(home[1]) || home[2:] || '_Layer' END,
                        CASE quality WHEN 1 THEN 'Quality_Pass' WHEN 0 THEN 'Quality_Quarantine' END,
                        CASE WHEN toxic = 1 THEN 'PII' END], lambda x: x IS NOT NULL) AS classifications,
           CASE source WHEN 'src13' THEN '' WHEN 'src15' THEN 'soon'
                ELSE strftime(DATE '2024-07-01' - CAST(n_chars // 50 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' END AS ingested_at,
           CASE WHEN quality = 1 THEN
                strftime(DATE '2024-07-01' - CAST(n_chars // 200 AS INTEGER), '%Y-%m-%d') || 'T06:00:00Z' END AS enriched_at,
           home, lang, source, n_chars, quality, toxic
    FROM (SELECT *, CASE WHEN n_chars < 100 THEN 'tmp' ELSE home END AS prefix,
                 CASE WHEN quality = 1 THEN '{{"source_score":' || CAST(n_chars // 20 AS VARCHAR) || ',"source_status":"PASS"}}'
                      WHEN quality = 0 THEN '{{"source_status":"QUARANTINE"}}'
                      WHEN n_chars > 2000 THEN '{{"source_status":"PASS"}}' ELSE '{{}}' END AS quality_doc,
                 CASE WHEN n_chars > 800 THEN '["' || lang || ' text","' || source || '"]' ELSE '[]' END AS terms_doc
          FROM (SELECT d.doc_id, lang, source, n_chars, quality, toxic, CASE lang WHEN 'fr' THEN 'staging'
                       WHEN 'de' THEN 'bronze' WHEN 'en' THEN 'silver' WHEN 'es' THEN 'gold' END AS home
                FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)))"""

LAYER = """coalesce(nullif(layer, ''), nullif(regexp_extract(qualified_name, '^(staging|bronze|silver|gold)\\.', 1), ''),
           'unknown')"""
_P = "CASE WHEN json_valid(profiling) AND json_type(profiling) = 'OBJECT' THEN profiling END"


def _jp(path: str) -> str:
    """Text of a field of the profiling document."""
    return f"json_extract_string({_P}, '$.{path}')"


def document_assets(spark, sf_dir) -> DataFrame:
    """One asset per document, in the column layout of the catalog."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    base = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, source, lang = F.col("n_chars"), F.col("source"), F.col("lang")
    good, poor, toxic = (F.col(c).eqNullSafe(v) for c, v in (("quality", 1), ("quality", 0), ("toxic", 1)))
    home = reduce(lambda w, kv: w.when(lang == kv[0], kv[1]), LAYER_BY_LANG.items(), F)
    prefix = F.when(n < 100, "tmp").otherwise(F.col("home"))
    units = lambda size: F.floor(n / size).cast("string")
    quality_doc = (
        F.when(good, F.concat(F.lit('{"source_score":'), units(20), F.lit(',"source_status":"PASS"}')))
        .when(poor, F.lit('{"source_status":"QUARANTINE"}'))
        .when(n > 2000, F.lit('{"source_status":"PASS"}'))
        .otherwise(F.lit("{}"))
    )
    terms = F.when(n > 800, F.concat(F.lit('["'), lang, F.lit(' text","'), source, F.lit('"]'))).otherwise("[]")
    compliance = F.when(
        n > 500,
        F.concat(
            F.lit(',"compliance":{"contains_pii":'), F.when(toxic, "true").otherwise("false"),
            F.lit(',"data_classification":"Internal","retention_policy":"7 years"}'),
        ),
    ).otherwise("")
    silver_doc = F.concat(
        F.lit(f'{{"columns":{BRONZE_DOC},"quality":'), quality_doc,
        F.lit(',"business":{"owner":"'), F.when(source < "src2", source).otherwise(""),
        F.lit('","iku_relevance":[],"glossary_terms":'), terms, F.lit(',"update_frequency":"Yearly"}'),
        compliance, F.lit(',"transformations":["DEDUP on doc_id","","FLAG toxic"]}'),
    )
    gold_doc = (
        F.when(
            n > 1500,
            F.concat(
                F.lit('{"star_schema":{"table_type":"fact"},"kpi":{"iku_code":"IKU-'), units(1500),
                F.lit('","iku_nama":"Text length class '), units(1500),
                F.lit('"},"consumption":{"consumers":["board"]}}'),
            ),
        )
        .when(n > 300, F.lit('{"star_schema":{"table_type":"dimension"},"quality":{"source_status":"PASS"}}'))
        .otherwise(F.lit("[1]"))
    )
    days_ago = lambda size, time: F.concat(
        F.date_sub(F.lit("2024-07-01").cast("date"), F.floor(n / size).cast("int")).cast("string"), F.lit(time)
    )
    missing = F.lit(None).cast("string")
    return base.withColumn("home", home).select(
        F.concat(prefix, F.lit(".doc_"), "doc_id", F.lit("@lake")).alias("qualified_name"),
        F.when(source == "src3", "").otherwise(F.concat(F.lit("doc_"), "doc_id")).alias("name"),
        F.lit(DATASET).alias("type_name"),
        F.when((prefix != "tmp") & ~poor, F.col("home")).alias("layer"),
        F.when(source != "src5", "parquet").alias("format"),
        F.concat(
            F.when(source == "src7", "s3a://Landing/").otherwise(
                F.concat(F.lit("s3a://warehouse/"), "home", F.lit("/"))
            ),
            source,
        ).alias("location"),
        F.when(~toxic, F.concat(F.lit("Text in "), lang, F.lit(" from "), source)).alias("description"),
        F.when(source == "src11", F.lit(-1)).when(source != "src9", n).cast("bigint").alias("row_count"),
        F.lit(5).alias("column_count"),
        F.when(source == "src2", "{}").when(source == "src4", "zzz")
        .otherwise('{"doc_id":"LongType()","text":"StringType()"}').alias("schema_def"),
        F.when(F.col("home") == "bronze", F.lit(BRONZE_DOC)).when(F.col("home") == "silver", silver_doc)
        .when(F.col("home") == "gold", gold_doc).otherwise(missing).alias("profiling"),
        F.when(toxic, '["text"]').otherwise("[]").alias("pii_columns"),
        F.array_compact(
            F.array(
                F.when(n >= 60, F.concat(F.initcap("home"), F.lit("_Layer"))),
                F.when(good, "Quality_Pass").when(poor, "Quality_Quarantine"),
                F.when(toxic, "PII"),
            )
        ).alias("classifications"),
        F.when(source == "src13", "").when(source == "src15", "soon").otherwise(days_ago(50, "T00:00:00Z")).alias(
            "ingested_at"
        ),
        F.when(good, days_ago(200, "T06:00:00Z")).alias("enriched_at"),
    )


def _sql(body: str, more: str = "") -> str:
    return f"WITH {ASSETS}{more} {body}"


@query(
    _sql(
        f"""SELECT l.layer, count(a.layer) AS assets
            FROM (VALUES ('staging'), ('bronze'), ('silver'), ('gold')) l(layer)
            LEFT JOIN (SELECT {LAYER} AS layer FROM assets) a ON a.layer = l.layer GROUP BY l.layer"""
    )
)
def assets_by_layer(spark, sf_dir):
    return governance.count_by_layer(document_assets(spark, sf_dir))


@query(_sql("SELECT tag, count(*) AS assets FROM (SELECT unnest(list_distinct(classifications)) AS tag FROM assets) GROUP BY tag"))
def assets_by_tag(spark, sf_dir):
    return governance.count_by_tag(document_assets(spark, sf_dir))


@query(
    _sql(
        """SELECT passed, quarantined, CAST(CASE WHEN passed + quarantined = 0 THEN 0
                  ELSE round(passed / (passed + quarantined) * 100) END AS INTEGER) AS pass_pct
           FROM (SELECT count(*) FILTER (list_contains(classifications, 'Quality_Pass')) AS passed,
                        count(*) FILTER (list_contains(classifications, 'Quality_Quarantine')) AS quarantined FROM assets)"""
    )
)
def pass_rate(spark, sf_dir):
    return governance.pass_rate(document_assets(spark, sf_dir))


@query(
    _sql(
        f"""SELECT qualified_name, name, row_count FROM assets
           WHERE type_name = '{DATASET}' AND list_contains(classifications, 'PII')
             AND (lower(name) LIKE '%doc_1%' OR lower(qualified_name) LIKE '%doc_1%' OR lower(description) LIKE '%doc_1%')
           ORDER BY qualified_name"""
    )
)
def asset_search(spark, sf_dir):
    found = catalog.search(document_assets(spark, sf_dir), DATASET, "DOC_1", "PII")
    return found.select("qualified_name", "name", "row_count").orderBy("qualified_name")


@query(
    _sql(
        """SELECT qualified_name, name FROM assets
           WHERE lower(description) LIKE '%from src1%' AND list_contains(classifications, 'Silver_Layer')
           ORDER BY qualified_name LIMIT 10 OFFSET 5"""
    )
)
def asset_page(spark, sf_dir):
    found = catalog.search(document_assets(spark, sf_dir), query="from SRC1", classification="Silver_Layer")
    return catalog.page(found.select("qualified_name", "name"), ["qualified_name"], 10, 5)


@query(
    _sql("SELECT qualified_name, name, layer FROM assets WHERE qualified_name = (SELECT max(qualified_name) FROM assets)")
)
def asset_lookup(spark, sf_dir):
    """Exact name lookup of the asset that sorts last."""
    assets = document_assets(spark, sf_dir)
    last = assets.select(F.max("qualified_name")).scalar()
    return catalog.by_qualified_name(assets, last).select("qualified_name", "name", "layer")


UMT = f"""SELECT qualified_name AS asset_qualified_name, {LAYER} AS layer, format, location, row_count, column_count,
                 CAST(CASE WHEN json_valid(schema_def) AND json_type(schema_def) = 'OBJECT'
                      THEN len(json_keys(schema_def)) ELSE 0 END AS INTEGER) AS schema_size,
                 CAST(len(from_json(pii_columns, '["VARCHAR"]')) AS INTEGER) AS pii_count, description,
                 {_jp("business.owner")} AS owner, {_jp("business.update_frequency")} AS update_frequency,
                 CAST(coalesce(json_array_length({_P}, '$.business.glossary_terms'), 0) AS INTEGER) AS terms,
                 {_jp("kpi")} AS kpi, {_jp("consumption")} AS consumption, {_jp("quality")} AS quality,
                 {_jp("compliance")} AS compliance, {_jp("star_schema")} AS star_schema,
                 array_to_string(classifications, ',') AS tags,
                 coalesce(nullif(enriched_at, ''), CASE WHEN {LAYER} <> 'unknown' THEN nullif(ingested_at, '') END) AS last_enriched_at
          FROM assets"""


@query(_sql(UMT))
def unified_metadata(spark, sf_dir):
    umt = catalog.unified_metadata(document_assets(spark, sf_dir))
    return umt.select(
        "asset_qualified_name", "layer",
        "technical.format", "technical.location", "technical.row_count", "technical.column_count",
        F.size("technical.schema").alias("schema_size"), F.size("technical.pii_columns").alias("pii_count"),
        "business.description", "business.owner", "business.update_frequency",
        F.size("business.glossary_terms").alias("terms"), "business.kpi", "business.consumption",
        "operational.quality", "operational.compliance", "operational.star_schema",
        F.array_join("operational.classifications", ",").alias("tags"), "last_enriched_at",
    )


@query()
def unified_metadata_documents(spark, sf_dir):
    """The three documents of every asset as JSON text, in layer order; text layout is not SQL-comparable."""
    return catalog.umt_documents(catalog.in_layer_order(catalog.unified_metadata(document_assets(spark, sf_dir))))


@query(
    _sql(
        f"""SELECT CAST(row_number() OVER (ORDER BY CASE layer WHEN 'staging' THEN 0 WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2
                        WHEN 'gold' THEN 3 WHEN 'unknown' THEN 4 ELSE 99 END, qualified_name) AS BIGINT) AS place,
                   qualified_name AS asset_qualified_name, layer
            FROM (SELECT qualified_name, {LAYER} AS layer FROM assets)
            QUALIFY place <= 50 ORDER BY place"""
    )
)
def unified_metadata_top(spark, sf_dir):
    """The first fifty rows of the table in layer order, numbered."""
    places = catalog.layer_places(catalog.unified_metadata(document_assets(spark, sf_dir)))
    return places.where("place <= 50").select("place", "asset_qualified_name", "layer")


@query(
    _sql(
        f"""SELECT CAST(row_number() OVER (ORDER BY CASE layer WHEN 'staging' THEN 0 WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2
                        WHEN 'gold' THEN 3 WHEN 'unknown' THEN 4 ELSE 99 END, qualified_name) AS BIGINT) AS place,
                   qualified_name AS asset_qualified_name, layer
            FROM (SELECT qualified_name, {LAYER} AS layer FROM assets)"""
    )
)
def unified_metadata_order(spark, sf_dir):
    """The place of every asset in layer order."""
    places = catalog.layer_places(catalog.unified_metadata(document_assets(spark, sf_dir)))
    return places.select("place", "asset_qualified_name", "layer")


@query(_sql(f"SELECT asset_qualified_name, last_enriched_at FROM ({UMT}) WHERE layer = 'gold'"))
def unified_metadata_gold(spark, sf_dir):
    gold = catalog.in_layer(catalog.unified_metadata(document_assets(spark, sf_dir)), "gold")
    return gold.select("asset_qualified_name", "last_enriched_at")


def _filled(x: str) -> str:
    return f"coalesce(trim({x}) NOT IN ('', '{{}}', '[]', 'null'), false)"


def _score_sql(checks: list[str]) -> str:
    passed = " + ".join(f"CAST(coalesce({c}, false) AS INTEGER)" for c in checks)
    return f"CAST(round(({passed}) / {len(checks)} * 100) AS INTEGER)"


_SCHEMA_SIZE = "CASE WHEN json_valid(schema_def) AND json_type(schema_def) = 'OBJECT' THEN len(json_keys(schema_def)) ELSE 0 END"
_BASE = [
    *[_filled(c) for c in ("qualified_name", "name", "description", "layer", "format", "location")],
    f"{_SCHEMA_SIZE} > 0",
    "row_count IS NOT NULL",
    f"{_filled('ingested_at')} OR {_filled('enriched_at')}",
]
_SILVER = [
    _filled(_jp("business.owner")),
    _filled(_jp("business.glossary_terms")),
    f"coalesce(len(json_keys({_P}, '$.quality')), 0) > 0",
    _filled(_jp("compliance")),
]
_IN_STAR = f"({_filled(_jp('star_schema.table_type'))} OR {_filled(_jp('kpi.iku_code'))})"
_GOLD = [_IN_STAR, _filled(_jp("consumption")), _filled("enriched_at")]
_STATED = f"CAST({_jp('quality.source_score')} AS DOUBLE)"
_STAMP = "TRY_CAST(coalesce(nullif(enriched_at, ''), nullif(ingested_at, '')) AS TIMESTAMPTZ)"
_AGE = f"(epoch(TIMESTAMPTZ '2024-07-01 00:00:00+00') - epoch({_STAMP})) / 86400.0"

SCORES = f"""scores AS (
    SELECT qualified_name, ev AS evaluated_layer,
           CASE ev WHEN 'bronze' THEN {_score_sql(_BASE)} WHEN 'silver' THEN {_score_sql(_BASE + _SILVER)}
                ELSE {_score_sql(_BASE + _GOLD)} END AS completeness,
           CAST(CASE WHEN {_SCHEMA_SIZE} = 0 OR coalesce(row_count < 0, false) THEN 0 WHEN ev = 'bronze' THEN 95
                WHEN {_STATED} IS NOT NULL THEN least(100, greatest(0, round({_STATED})))
                WHEN {_jp("quality.source_status")} = 'PASS' THEN 90 WHEN {_jp("quality.source_status")} = 'QUARANTINE' THEN 70
                WHEN ev = 'silver' THEN 85 WHEN {_IN_STAR} THEN 92 ELSE 75 END AS INTEGER) AS accuracy,
           CASE WHEN {_STAMP} IS NULL THEN 0 WHEN {_AGE} <= 7 THEN 100 WHEN {_AGE} <= 30 THEN 90 WHEN {_AGE} <= 90 THEN 75
                WHEN {_AGE} <= 180 THEN 60 ELSE 40 END AS timeliness,
           {_score_sql([
               "layer = ev", f"{LAYER} = ev", "starts_with(qualified_name, ev || '.')",
               "list_contains(classifications, upper(ev[1]) || ev[2:] || '_Layer')", "contains(lower(location), ev)",
           ])} AS consistency
    FROM (SELECT *, unnest(list_filter(['bronze', 'silver', 'gold'],
                 lambda x: list_contains(classifications, upper(x[1]) || x[2:] || '_Layer'))) AS ev FROM assets))"""


@query(_sql("SELECT * FROM scores", ", " + SCORES))
def metadata_quality_assets(spark, sf_dir):
    return governance.asset_scores(document_assets(spark, sf_dir), AS_OF)


def _five(x: str) -> str:
    return f"CAST(least(5, greatest(1, round({x} / 20))) AS INTEGER) AS {x}_score_1_5"


@query(
    _sql(
        f"""SELECT layer, upper(layer[1]) || layer[2:] AS label, entity_count, completeness, accuracy, timeliness, consistency,
                   {", ".join(_five(s) for s in governance.SCORES)}
            FROM (SELECT l.layer, count(s.evaluated_layer) AS entity_count,
                         {", ".join(f"CAST(coalesce(round(avg({s})), 0) AS INTEGER) AS {s}" for s in governance.SCORES)}
                  FROM (VALUES ('bronze'), ('silver'), ('gold')) l(layer)
                  LEFT JOIN scores s ON s.evaluated_layer = l.layer GROUP BY l.layer)""",
        ", " + SCORES,
    )
)
def metadata_quality_layers(spark, sf_dir):
    return governance.layer_report(governance.asset_scores(document_assets(spark, sf_dir), AS_OF))


@query(
    _sql(
        f"""SELECT layer, count(*) AS entity_count,
                   round(count(*) FILTER (schema_def NOT IN ('', '{{}}')) / count(*) * 100, 2) AS schema_documented_pct,
                   round(count(*) FILTER (owner <> '') / count(*) * 100, 2) AS owner_steward_pct,
                   round(count(*) FILTER (terms > 0) / count(*) * 100, 2) AS glossary_term_pct,
                   round(count(*) FILTER (list_contains(classifications, 'PII')) / count(*) * 100, 2) AS classification_pii_pct
            FROM (SELECT {LAYER} AS layer, schema_def, classifications, {_jp("business.owner")} AS owner,
                         coalesce(json_array_length({_P}, '$.business.glossary_terms'), 0) AS terms FROM assets)
            WHERE layer IN ('bronze', 'silver', 'gold') GROUP BY layer"""
    )
)
def metadata_coverage(spark, sf_dir):
    return governance.coverage(document_assets(spark, sf_dir))


@query(
    _sql(
        f"""SELECT qualified_name, layer, stage, CASE WHEN stage <= 4 THEN 'Sandbox' WHEN stage <= 9 THEN 'Enrichment'
                   WHEN stage <= 13 THEN 'Production' ELSE 'Evolution' END AS zone
            FROM (SELECT qualified_name, layer, CASE layer WHEN 'gold' THEN 13 WHEN 'silver' THEN 10
                         WHEN 'bronze' THEN CASE WHEN quality IN (0, 1) THEN 9 ELSE 7 END WHEN 'staging' THEN 4 ELSE 3 END AS stage
                  FROM (SELECT qualified_name, {LAYER} AS layer, quality FROM assets))"""
    )
)
def lifecycle_stage(spark, sf_dir):
    return catalog.lifecycle(document_assets(spark, sf_dir))


@query(
    _sql(
        f"""SELECT qualified_name, CASE WHEN says THEN score END AS quality_score, CASE WHEN says THEN status END AS quality_status
            FROM (SELECT qualified_name, {_STATED} AS score, coalesce({_jp("quality.source_status")}, 'UNKNOWN') AS status,
                         {_STATED} IS NOT NULL OR {_jp("quality.source_status")} IS NOT NULL AS says FROM assets)"""
    )
)
def quality_meta(spark, sf_dir):
    return catalog.quality_meta(document_assets(spark, sf_dir))


@query(
    _sql(
        f"""SELECT qualified_name, owner IS NOT NULL OR freq IS NOT NULL OR terms > 0 AS has_business, owner,
                   freq AS update_frequency, CAST(terms AS INTEGER) AS terms
            FROM (SELECT qualified_name, nullif({_jp("business.owner")}, '') AS owner,
                         nullif({_jp("business.update_frequency")}, '') AS freq,
                         coalesce(json_array_length({_P}, '$.business.glossary_terms'), 0) AS terms FROM assets)"""
    )
)
def business_meta(spark, sf_dir):
    meta = catalog.business_meta(document_assets(spark, sf_dir))
    return meta.select(
        "qualified_name", "has_business", "owner", "update_frequency", F.size("glossary_terms").alias("terms")
    )


@query(
    _sql(
        f"""SELECT qualified_name, contains_pii IS NOT NULL OR class IS NOT NULL AS has_compliance, contains_pii,
                   CAST(CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS INTEGER) AS pii_count, class AS data_classification,
                   {_jp("compliance.retention_policy")} AS retention_policy
            FROM (SELECT *, coalesce(CAST({_jp("compliance.contains_pii")} AS BOOLEAN), CASE WHEN toxic = 1 THEN true END)
                         AS contains_pii, {_jp("compliance.data_classification")} AS class FROM assets)"""
    )
)
def compliance_meta(spark, sf_dir):
    meta = catalog.compliance_meta(document_assets(spark, sf_dir))
    return meta.select(
        "qualified_name", "has_compliance", "contains_pii", F.size("pii_columns").alias("pii_count"),
        "data_classification", "retention_policy",
    )


@query(
    _sql(
        """SELECT qualified_name, CASE WHEN home = 'silver' THEN 'DEDUP on doc_id; FLAG toxic' ELSE '' END AS steps FROM assets"""
    )
)
def transformation_steps(spark, sf_dir):
    steps = catalog.transformations(document_assets(spark, sf_dir))
    return steps.select("qualified_name", F.array_join("transformations", "; ").alias("steps"))


@query(
    _sql(
        """SELECT qualified_name, CAST(CASE WHEN home IN ('bronze', 'silver') THEN 1 ELSE 0 END AS INTEGER) AS columns,
                  CAST(CASE WHEN home IN ('bronze', 'silver') THEN 100.0 END AS DOUBLE) AS completeness_pct FROM assets"""
    )
)
def column_profiling(spark, sf_dir):
    """Column profiles out of both document shapes; documents without any give none."""
    from strata.functions.documents import column_stats

    stats = document_assets(spark, sf_dir).withColumn("stats", column_stats("profiling"))
    return stats.select(
        "qualified_name",
        F.size("stats").alias("columns"),
        F.col("stats")["text"]["completeness_pct"].alias("completeness_pct"),
    )


# Definitions of some of the terms in use; the others get the default text.
DEFINITIONS = {"en text": ("English prose", "Language"), "src1": ("First feed", "Feed"), "src10": ("Tenth feed", "Feed")}
_DEF_VALUES = ", ".join(f"('{t}', '{d}', '{c}')" for t, (d, c) in DEFINITIONS.items())

LINKS = f"""links AS (
    SELECT DISTINCT term, 'silver_metadata' AS source, qualified_name FROM (
        SELECT qualified_name, unnest(from_json(json_extract({_P}, '$.business.glossary_terms'), '["VARCHAR"]')) AS term FROM assets)
    UNION
    SELECT {_jp("kpi.iku_code")}, 'gold_metadata', qualified_name FROM assets
    WHERE {LAYER} = 'gold' AND {_jp("kpi.iku_code")} <> '')"""
TERMS = f"""terms AS (
    SELECT l.term, CASE WHEN l.source = 'gold_metadata' THEN 'Text length class ' || l.term[5:]
                   ELSE coalesce(d.definition, 'Term of the catalog: ' || l.term) END AS definition,
           CASE WHEN l.source = 'gold_metadata' THEN 'Business' ELSE coalesce(d.category, 'Business') END AS category,
           l.source, count(*) AS related_assets
    FROM links l LEFT JOIN (VALUES {_DEF_VALUES}) d(term, definition, category) ON l.term = d.term GROUP BY ALL)"""


@query(_sql("SELECT term, source, qualified_name FROM links", ", " + LINKS))
def glossary_links(spark, sf_dir):
    return glossary.term_links(document_assets(spark, sf_dir)).select("term", "source", "qualified_name")


def _terms(spark, sf_dir) -> DataFrame:
    known = glossary.dictionary(spark, DEFINITIONS)
    return glossary.glossary_terms(document_assets(spark, sf_dir), known, "Term of the catalog: ")


@query(_sql("SELECT * FROM terms", f", {LINKS}, {TERMS}"))
def glossary_terms(spark, sf_dir):
    return _terms(spark, sf_dir)


@query(
    _sql(
        """SELECT term, definition, category, source FROM (
               SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY rank, term, definition) AS rn FROM (
                   SELECT n_name AS term, 'Nation ' || n_nationkey AS definition, 'Place' AS category, 'catalog' AS source, 0 AS rank FROM nation
                   UNION ALL SELECT term, definition, category, source, 1 FROM terms
                   UNION ALL SELECT DISTINCT upper(source), 'Source of documents', 'Feed', 'local', 2 FROM documents
                   UNION ALL SELECT lower(n_name), 'Local nation', 'Place', 'local', 2 FROM nation))
           WHERE rn = 1""",
        f", {LINKS}, {TERMS}",
    )
)
def glossary_merged(spark, sf_dir):
    """Nations as catalog terms, the collected terms, and local ones that differ only by case."""
    nation = table(spark, sf_dir, "nation")
    official = nation.select(
        F.col("n_name").alias("term"),
        F.concat(F.lit("Nation "), "n_nationkey").alias("definition"),
        F.lit("Place").alias("category"),
    )
    sources = table(spark, sf_dir, "documents").select(F.upper("source").alias("term")).distinct()
    local = sources.select("term", F.lit("Source of documents").alias("definition"), F.lit("Feed").alias("category"))
    local = local.unionByName(
        nation.select(
            F.lower("n_name").alias("term"), F.lit("Local nation").alias("definition"), F.lit("Place").alias("category")
        )
    )
    return glossary.merge_glossary(official, _terms(spark, sf_dir), local)


@query(_sql("SELECT DISTINCT category FROM terms ORDER BY category", f", {LINKS}, {TERMS}"))
def glossary_categories(spark, sf_dir):
    return glossary.categories(_terms(spark, sf_dir))


@query(
    _sql(
        f"""SELECT code, min(qualified_name) AS qualified_name, count(*) AS matches FROM assets,
                   (VALUES ('IKU-1', 'fact_doc_11'), ('IKU-2', 'doc_22@'), ('IKU-9', 'fact_nowhere')) k(code, fact)
            WHERE name = fact OR contains(qualified_name, fact)
               OR (layer = 'gold' AND contains(name, replace(fact, 'fact_', ''))) OR {_jp("kpi.iku_code")} = code
            GROUP BY code"""
    )
)
def kpi_asset_match(spark, sf_dir):
    kpis = [
        {"code": "IKU-1", "fact": "fact_doc_11"},
        {"code": "IKU-2", "fact": "doc_22@"},
        {"code": "IKU-9", "fact": "fact_nowhere"},
    ]
    return kpi.match_kpi_assets(document_assets(spark, sf_dir), kpis)


@query(
    _sql(
        f"""SELECT 'IKU-' || c_custkey AS code, min(qualified_name) AS qualified_name, count(*) AS matches FROM assets, customer
            WHERE name = 'fact_doc_' || c_custkey OR contains(qualified_name, 'fact_doc_' || c_custkey)
               OR (layer = 'gold' AND contains(name, 'doc_' || c_custkey)) OR {_jp("kpi.iku_code")} = 'IKU-' || c_custkey
            GROUP BY c_custkey"""
    )
)
def kpi_asset_match_all(spark, sf_dir):
    """One indicator per customer against the assets of all documents."""
    key = F.col("c_custkey").cast("string")
    kpis = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("IKU-"), key).alias("code"), F.concat(F.lit("fact_doc_"), key).alias("fact")
    )
    return kpi.match_kpi_assets(document_assets(spark, sf_dir), kpis)


@query(
    _sql(
        """SELECT 'silver' AS layer, '2024-07-01T00:00:00Z' AS generated_at, count(*) AS datasets,
                  (SELECT count(DISTINCT o_orderkey) FROM orders) AS processes,
                  count(*) FILTER (list_contains(classifications, 'Silver_Layer')) AS classified FROM assets"""
    )
)
def registration_snapshot(spark, sf_dir):
    processes = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return governance.registration_snapshot(document_assets(spark, sf_dir), processes, "silver", AS_OF)


@query(
    """SELECT doc_id, CASE WHEN new THEN 'v2' ELSE 'v1' END AS version, n_chars
       FROM (SELECT d.doc_id, n_chars, l.doc_id IS NOT NULL AS new FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
)
def catalog_upsert(spark, sf_dir):
    """All documents as current rows, the labelled ones again as newer versions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    current = docs.withColumns({"version": F.lit("v1"), "stamp": F.lit(1)})
    changes = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    changes = changes.withColumns({"version": F.lit("v2"), "stamp": F.lit(2)})
    return catalog.upsert(current, changes, "stamp", "doc_id").drop("stamp")


@query(
    """SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' ELSE 'documents' END AS list
       FROM (SELECT d.doc_id AS doc_id FROM documents d) LEFT JOIN labels l USING (doc_id)"""
)
def merge_lists(spark, sf_dir):
    """Search results merged by id; the last list that has the id wins."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("list"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("list"))
    return catalog.merge_by_key([documents, labels], "doc_id")


@query(
    """SELECT event_type, count(*) AS events, count(*) FILTER (trim(coalesce(json_extract_string(props, '$.k'), '')) <> '') AS with_k,
              CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
              count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS without_other,
              round(avg(len(json_keys(props))), 2) AS mean_keys
       FROM events GROUP BY event_type"""
)
def props_coverage(spark, sf_dir):
    """Fill rate of the keys in a JSON column."""
    events = table(spark, sf_dir, "events").withColumn("doc", json_object("props"))
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(filled(F.col("doc")["k"])).alias("with_k"),
        F.sum(F.col("doc")["k"].try_cast("bigint")).alias("sum_k"),
        F.count_if(json_field("props", "missing").isNull()).alias("without_other"),
        F.round(F.avg(F.size("doc")), 2).alias("mean_keys"),
    )


CLUSTER, WAREHOUSE = "lake", "s3a://warehouse"
REGISTERED = {
    "customer": ["c_name", "c_acctbal", "c_phone"],
    "supplier": ["s_name"],
    "nation": [],
    "orders": [],
}
COLUMN_NAMES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


def _bronze_profiles(spark, sf_dir) -> DataFrame:
    """Profiles of four tables with the PII columns that are both listed and present."""
    columns = union_all([profile.profile_columns(table(spark, sf_dir, t), t) for t in REGISTERED])
    return catalog.with_pii_columns(profile.table_profile(columns), REGISTERED)


@query(
    "\nUNION ALL\n".join(
        f"""SELECT 'bronze.{t}@lake' AS qualified_name, 'bronze_{t}' AS name, 's3a://warehouse/bronze/{t}' AS location, count(*) AS row_count,
                   {len(COLUMN_NAMES[t])} AS column_count,
                   '{"[" + ",".join(f'"{c}"' for c in COLUMN_NAMES[t] if c in pii) + "]"}' AS pii_columns,
                   '{"Bronze_Layer,PII" if set(pii) & set(COLUMN_NAMES[t]) else "Bronze_Layer"}' AS tags,
                   count(DISTINCT {COLUMN_NAMES[t][0]}) AS distinct_keys FROM {t}"""
        for t, pii in REGISTERED.items()
    )
)
def catalog_bronze(spark, sf_dir):
    """Assets of four raw tables from their profiles."""
    assets = catalog.bronze_assets(_bronze_profiles(spark, sf_dir), CLUSTER, WAREHOUSE, AS_OF)
    keys = {t: names[0] for t, names in COLUMN_NAMES.items()}
    distinct = [json_field("profiling", f"{k}.distinct_count").try_cast("bigint") for k in keys.values()]
    return assets.select(
        "qualified_name", "name", "location", "row_count", "column_count", "pii_columns",
        F.array_join("classifications", ",").alias("tags"), F.coalesce(*distinct).alias("distinct_keys"),
    )


@query(
    "\nUNION ALL\n".join(
        f"SELECT 'staging.{t}@lake' AS qualified_name, '{t}' AS name, 's3a://landing/{t}.csv' AS location, 'Staging_Layer' AS tags "
        f"FROM (SELECT count(*) AS n FROM {t}) WHERE n > 0"
        for t in REGISTERED
    )
)
def catalog_staging(spark, sf_dir):
    """Assets of the files that hold rows."""
    from strata.sources.read import dataset_summary

    summary = dataset_summary(spark, sf_dir, "parquet").where(F.col("table_name").isin(*REGISTERED))
    assets = catalog.staging_assets(summary.where("row_count > 0"), CLUSTER, "s3a://landing")
    return assets.select("qualified_name", "name", "location", F.array_join("classifications", ",").alias("tags"))


_BUSINESS = "table_name string, business_description string, business_owner string, iku_relevance array<string>, glossary_terms array<string>, update_frequency string"
_COMPLIANCE = "table_name string, contains_pii boolean, pii_columns array<string>, data_classification string, retention_policy string, access_restriction string"


@query(
    """SELECT 'silver.silver_customer@lake' AS qualified_name, 'Customers with nation and region' AS description, count(*) AS row_count,
              9 AS column_count, 'Silver_Layer,Quality_Pass,PII' AS tags, 'Sales' AS owner, 'PASS' AS status,
              CAST(100.0 AS DOUBLE) AS source_score, 'Internal' AS data_classification, '["c_name"]' AS pii_columns FROM customer
       UNION ALL
       SELECT 'silver.silver_orders@lake', 'Silver table: silver_orders', count(*), 9, 'Silver_Layer,Quality_Quarantine', '',
              'QUARANTINE', 75.0, NULL, '[]' FROM orders"""
)
def catalog_silver(spark, sf_dir):
    """Assets of refined tables; one without business and compliance attributes, one not written."""
    from strata.queries.refinement import enrich_customer

    gates = {"silver_customer": (100.0, "PASS"), "silver_orders": (75.0, "QUARANTINE"), "silver_lost": (10.0, "REJECT")}
    frames = {
        "silver_customer": (enrich_customer(spark, sf_dir), ["customer", "nation"]),
        "silver_orders": (orders_with_flags(spark, sf_dir), ["orders"]),
        "silver_lost": (table(spark, sf_dir, "nation"), ["nation"]),
    }
    profiles = union_all(
        [
            profile.profile_with_provenance(df, t, *gates[t], ["DEDUP"], sources, plan="once").withColumn(
                "written", F.lit(gates[t][1] != "REJECT")
            )
            for t, (df, sources) in frames.items()
        ]
    )
    business = spark.createDataFrame(
        [("silver_customer", "Customers with nation and region", "Sales", ["IKU-1"], ["Customer"], "Daily")], _BUSINESS
    )
    compliance = spark.createDataFrame(
        [("silver_customer", True, ["c_name"], "Internal", "7 years", "Role: sales")], _COMPLIANCE
    )
    assets = catalog.silver_assets(profiles, business, compliance, CLUSTER, WAREHOUSE, AS_OF)
    return assets.select(
        "qualified_name", "description", "row_count", "column_count", F.array_join("classifications", ",").alias("tags"),
        json_field("profiling", "business.owner").alias("owner"),
        json_field("profiling", "quality.source_status").alias("status"),
        json_field("profiling", "quality.source_score").try_cast("double").alias("source_score"),
        json_field("profiling", "compliance.data_classification").alias("data_classification"), "pii_columns",
    )


@query(
    """SELECT 'gold.fact_outcome@lake' AS qualified_name, 'OUT: Processed orders — Formula: processed / total * 100' AS description,
              'Gold_Layer,Star_Schema_Fact,KPI_Metric,Executive_Dashboard' AS tags, 'fact' AS table_type, 'OUT' AS kpi_code,
              'true' AS ml_ready, 'true' AS feature_store_candidate, 2 AS models, 1 AS consumers,
              (SELECT count(*) FROM (SELECT DISTINCT year(o_orderdate), c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)) AS row_count
       UNION ALL
       SELECT 'gold.dim_nation@lake', 'Gold dimension: dim_nation', 'Gold_Layer,Star_Schema_Dimension', 'dimension', NULL,
              'false', 'false', 0, 0, count(*) FROM nation"""
)
def catalog_gold(spark, sf_dir):
    """Assets of a KPI fact and a dimension."""
    from strata.queries.kpis import outcome_fact
    from strata.queries.refinement import dim_nation

    fact = outcome_fact(spark, sf_dir)
    summary = kpi.kpi_summary(fact, "fact_outcome", "processed_pct")
    profiles = kpi.gold_profile(fact, "fact_outcome", "fact", ["orders"], summary).unionByName(
        kpi.gold_profile(dim_nation(spark, sf_dir), "dim_nation", "dimension", ["nation"])
    )
    kpis = spark.createDataFrame(
        [("OUT", "Processed orders", "fact_outcome", "processed / total * 100", "%", "Plan", "Board")],
        "code string, name string, fact_table string, formula string, unit string, plan string, panel string",
    )
    consumption = spark.createDataFrame(
        [("fact_outcome", ["board"], "Fact")], "table_name string, consumers array<string>, olap_role string"
    )
    assets = catalog.gold_assets(
        profiles.withColumn("written", F.lit(True)), kpis, consumption, CLUSTER, WAREHOUSE, AS_OF
    )
    doc = lambda path: json_field("profiling", path)
    return assets.select(
        "qualified_name", "description", F.array_join("classifications", ",").alias("tags"),
        doc("star_schema.table_type").alias("table_type"), doc("kpi.iku_code").alias("kpi_code"),
        doc("ai_metadata.ml_ready").alias("ml_ready"),
        doc("ai_metadata.feature_store_candidate").alias("feature_store_candidate"),
        F.size(json_list(doc("ai_metadata.suggested_models"))).alias("models"),
        F.size(json_list(doc("consumption.consumers"))).alias("consumers"), "row_count",
    )
