"""Scalar expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import dates, documents, numbers, predicates, text
from strata.operators import catalog, governance, kpi, runs
from strata.operators.dims import MONTHS, TERMS
from strata.queries import ORACLE, query, table
from strata.queries.assets import AS_OF, document_assets
from strata.queries.kpis import FALLBACK, TARGETS, _kpi, _targets_sql, rounded
from strata.queries.refinement import MONTH_CASE
from strata.sources import read, runlog
from strata.sources.scratch import new_folder

K = "json_extract_string(props, '$.k')"


@query(
    f"""SELECT event_id, event_type = 'click' AS is_click, CAST({K} AS DOUBLE) >= 50 AS is_high,
               event_type = 'click' OR CAST({K} AS DOUBLE) >= 50 AS is_any,
               CASE WHEN event_type = 'view' THEN true WHEN event_type = 'error' THEN false END AS as_flag,
               event_type IN ('purchase', 'signup') AS is_member,
               CASE event_type WHEN 'view' THEN 'Seen' WHEN 'click' THEN 'Pressed' END AS label,
               coalesce(nullif(event_type, 'error'), 'none') AS kind, greatest(value, 1.0) AS floored
        FROM events"""
)
def flag_functions(spark, sf_dir):
    """Flags, membership, labels, defaults and floors."""
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").withColumn("k", documents.json_field("props", "k"))
    flagged = events.withColumns({"is_click": kind == "click", "is_high": predicates.at_least("k", 50)})
    flag_text = F.when(kind == "view", "True").when(kind == "error", "False").otherwise("")
    return flagged.select(
        "event_id",
        "is_click",
        "is_high",
        predicates.any_of(["is_click", "is_high"]).alias("is_any"),
        predicates.text_flag(flag_text).alias("as_flag"),
        kind.isin("purchase", "signup").alias("is_member"),
        text.label(kind, {"view": "Seen", "click": "Pressed"}).alias("label"),
        F.coalesce(F.nullif(kind, F.lit("error")), F.lit("none")).alias("kind"),
        numbers.floored(F.col("value"), 1).alias("floored"),
    )


@query(
    f"""SELECT o_orderkey, CAST(y AS INTEGER) AS year, CAST(y * 100 + 12 AS INTEGER) AS period_key,
               CASE WHEN m >= 8 OR m <= 1 THEN '{TERMS[0]}' ELSE '{TERMS[1]}' END AS term, {MONTH_CASE} AS month_name,
               CASE WHEN age <= 7 THEN 100 WHEN age <= 30 THEN 90 WHEN age <= 90 THEN 75 WHEN age <= 180 THEN 60 ELSE 40 END AS freshness,
               d >= DATE '1998-06-15' AS still_valid
        FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d,
                     CAST(DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS DOUBLE) AS age FROM orders)"""
)
def date_functions(spark, sf_dir):
    """Dates held as ISO text: year, period, term, month name, freshness, validity."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", iso.alias("d"), F.month("o_orderdate").alias("m"))
    stamp = dates.first_timestamp(F.lit(""), F.concat("d", F.lit("T00:00:00Z")))
    return orders.select(
        "o_orderkey",
        dates.year_of("d").alias("year"),
        dates.period_key(dates.year_of("d")).alias("period_key"),
        dates.study_term(F.col("m"), *TERMS).alias("term"),
        dates.month_name(F.col("m"), MONTHS).alias("month_name"),
        dates.freshness_score(stamp, "2001-08-01T00:00:00Z").alias("freshness"),
        predicates.still_valid("d", "1998-06-15").alias("still_valid"),
    )


@query(
    f"""SELECT c_custkey, {rounded("c_acctbal / 10000 * 100", 2)} AS share, {rounded("c_acctbal / 3000", 4)} AS ratio,
               least(100.0, greatest(0.0, c_acctbal / 50)) AS clamped,
               CAST(least(5, greatest(1, round(least(100.0, greatest(0.0, c_acctbal / 50)) / 20))) AS INTEGER) AS five_point,
               CASE WHEN c_acctbal / 50 >= 80 THEN 'PASS' WHEN c_acctbal / 50 >= 60 THEN 'QUARANTINE' ELSE 'REJECT' END AS gate,
               CASE WHEN c_acctbal >= 5000 THEN 'Tercapai' WHEN c_acctbal >= 4000 THEN 'On Track' ELSE 'Tidak Tercapai' END AS status,
               least(c_acctbal / 5000 * 100, 100.0) AS progress
        FROM customer"""
)
def number_functions(spark, sf_dir):
    """Shares, ratios, scales, status words and progress of account balances."""
    balance = F.col("c_acctbal")
    scaled = numbers.clamp(balance / 50, 0.0, 100.0)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        numbers.share_pct(balance, F.lit(10000)).alias("share"),
        numbers.ratio(balance, F.lit(3000)).alias("ratio"),
        scaled.alias("clamped"),
        numbers.five_point(scaled).alias("five_point"),
        numbers.gate_status(balance / 50).alias("gate"),
        numbers.target_status(balance, F.lit(5000.0)).alias("status"),
        numbers.progress_pct(balance, F.lit(5000.0), True).alias("progress"),
    )


@query(
    """SELECT doc_id, 'silver.' || source || '@lake' AS qualified, 'etl.load.' || source || '@lake' AS process,
              CASE WHEN lang IN ('de', 'en') THEN 'silver' ELSE 'unknown' END AS layer,
              upper(lang[1]) || lang[2:] || '_Layer' AS tag, contains(lower(source), 'rc1') AS has_rc1,
              replace(source, 'src', 'feed ') AS shown, lang || ' + ' || source AS joined, trim(source || '  ') AS trimmed,
              CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 3 WHEN 'fr' THEN 4 ELSE 99 END AS place
       FROM documents"""
)
def text_functions(spark, sf_dir):
    """Qualified names, layers, tags, search and joined texts."""
    source, lang = F.col("source"), F.col("lang")
    name = F.when(lang.isin("de", "en"), text.qualified_name("silver", source, "lake")).otherwise(F.lit("silverish.x"))
    layer = text.label(lang, {"de": "staging", "en": "gold", "fr": "unknown", "es": "elsewhere"})
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.qualified_name("silver", source, "lake").alias("qualified"),
        text.process_name("load", source, "lake").alias("process"),
        text.layer_from_name(name).alias("layer"),
        text.layer_tag(lang).alias("tag"),
        text.contains_text(source, "RC1").alias("has_rc1"),
        F.replace(source, F.lit("src"), F.lit("feed ")).alias("shown"),
        F.array_join(F.array(lang, source), " + ").alias("joined"),
        F.trim(F.concat(source, F.lit("  "))).alias("trimmed"),
        text.layer_rank(layer).alias("place"),
    )


@query(
    f"""SELECT event_id, {K} AS k, coalesce(json_extract_string(props, '$.other'), 'none') AS other,
               CAST(len(json_keys(props)) AS INTEGER) AS keys, CAST(0 AS INTEGER) AS keys_of_bad, {K} IN ('1', '2') AS in_list,
               1 AS texts, props NOT IN ('', '{{}}', '[]', 'null') AS is_filled
        FROM events"""
)
def json_functions(spark, sf_dir):
    """JSON fields with defaults, malformed JSON, lists and filled checks."""
    listed = documents.json_list(F.lit('["1","2"]'))
    pair = documents.json_list(F.concat(F.lit('["'), F.col("k"), F.lit('",""]')))
    events = table(spark, sf_dir, "events").withColumn("k", documents.json_field("props", "k"))
    return events.select(
        "event_id",
        "k",
        documents.json_field("props", "other", "none").alias("other"),
        F.size(documents.json_object("props")).alias("keys"),
        F.size(documents.json_object(F.concat(F.lit("["), "props", F.lit("]")))).alias("keys_of_bad"),
        F.array_contains(listed, F.col("k")).alias("in_list"),
        F.size(documents.non_empty_texts(pair)).alias("texts"),
        predicates.filled("props").alias("is_filled"),
    )


@query(
    f"""SELECT o_orderkey, coalesce(t.target, (SELECT target FROM {_targets_sql("OUT")} WHERE ty = {FALLBACK})) AS target
        FROM orders LEFT JOIN {_targets_sql("OUT")} t ON year(o_orderdate) = t.ty"""
)
def target_lookup(spark, sf_dir):
    """Target of the year of every order, by a join; the last year has none and gets the fallback year's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return kpi.with_target(orders, _kpi(spark, "OUT"), "year").select("o_orderkey", "target")


@query(
    f"""SELECT ty AS year, 'GRADE' AS code, CAST(NULL AS DOUBLE) AS target, grade AS target_label, n AS orders
        FROM (VALUES {", ".join(f"({y}, '{v['GRADE']}')" for y, v in TARGETS.items())}) t(ty, grade)
        JOIN (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) ON y = ty"""
)
def target_labels(spark, sf_dir):
    """Text targets with the orders of their year."""
    labels = kpi.target_table(spark, TARGETS).where("code = 'GRADE'")
    orders = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return labels.join(orders, "year")


@query(
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000
       ORDER BY o_orderdate, o_orderkey LIMIT 1"""
)
def first_match(spark, sf_dir):
    """First pending order over a price."""
    wanted = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") >= 100000)
    return catalog.first_match(table(spark, sf_dir, "orders"), wanted, ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_totalprice"
    )


def _experiment(spark, sf_dir):
    assets = document_assets(spark, sf_dir)
    records = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pipeline"),
        F.col("ts").alias("ended_at"),
        F.col("value").alias("duration_sec"),
        F.lit(1).cast("bigint").alias("rows_written"),
    )
    return runs.experiment_summary(
        "X-1",
        AS_OF,
        records,
        governance.layer_report(governance.asset_scores(assets, AS_OF)),
        governance.coverage(assets),
        catalog.unified_metadata(assets),
    )


@query(
    """SELECT 'X-1' AS experiment_id, count(*) AS pipelines, CAST(sum(duration) AS DOUBLE) AS pipeline_runtime_total_sec,
              CAST(3 AS INTEGER) AS quality_layers, CAST(3 AS INTEGER) AS coverage_layers, (SELECT count(*) FROM documents) AS umt_rows
       FROM (SELECT event_type, CAST(value AS DECIMAL(18,3)) AS duration, row_number() OVER
                    (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1"""
)
def experiment_summary(spark, sf_dir):
    """Run times, metadata quality, coverage and catalog size in one row."""
    return _experiment(spark, sf_dir).select(
        "experiment_id",
        F.size("pipelines").cast("bigint").alias("pipelines"),
        "pipeline_runtime_total_sec",
        F.size("metadata_quality").alias("quality_layers"),
        F.size("metadata_coverage").alias("coverage_layers"),
        "umt_rows",
    )


@query(
    """SELECT event_type AS pipeline, value AS duration_sec, CAST(1 AS BIGINT) AS rows_written
       FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1"""
)
def experiment_pipelines(spark, sf_dir):
    """The runs that the summary lists."""
    return _experiment(spark, sf_dir).select(F.inline("pipelines"))


@query(ORACLE["metadata_quality_layers"])
def experiment_quality(spark, sf_dir):
    """The metadata quality that the summary lists, by layer."""
    return _experiment(spark, sf_dir).select(F.inline("metadata_quality"))


@query(ORACLE["metadata_coverage"])
def experiment_coverage(spark, sf_dir):
    """The coverage that the summary lists, by layer."""
    return _experiment(spark, sf_dir).select(F.inline("metadata_coverage"))


_REPORTED = ("customer", "orders", "events", "documents")


@query(
    "\nUNION ALL\n".join(
        [f"SELECT 'dataset_summary' AS kind, {k} AS place, '{t}' AS item, count(*) AS n FROM {t}" for k in (1, 2, 3) for t in _REPORTED[: k + 1]]
        + [f"SELECT 'registration', {k}, 'processes', count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey % {k + 1} = 0" for k in (1, 2, 3)]
        + [f"SELECT 'registration', {k}, 'datasets', count(*) FROM documents" for k in (1, 2, 3)]
    )
)
def experiment_reports(spark, sf_dir):
    """The newest three dataset summaries and registration snapshots of an experiment by content; four of each were written."""
    folder = new_folder(spark, "reports")
    assets, orders = document_assets(spark, sf_dir), table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    summary = read.dataset_summary(spark, sf_dir, "parquet")
    for k in range(4):
        tables = summary.where(F.col("table_name").isin(*_REPORTED[: k + 1])).agg(
            F.sum("row_count").alias("total_rows"), F.array_sort(F.collect_list(F.struct("table_name", "row_count"))).alias("tables")
        )
        runlog.write_report(tables, folder, f"dataset_summary_{9 - k}")  # names do not follow the time
        snapshot = governance.registration_snapshot(assets, orders.where(F.col("o_orderkey") % (k + 1) == 0), "silver", AS_OF)
        runlog.write_report(snapshot, folder, f"registration_{k}")
    nothing = spark.createDataFrame([], "pipeline string, ended_at timestamp, duration_sec double, rows_written bigint")
    reports = runlog.read_reports(spark, folder, (runs.DATASET_SUMMARY, runs.REGISTRATION))
    found = runs.experiment_summary("X-1", AS_OF, nothing, nothing.select("pipeline"), nothing.select("pipeline"), nothing, reports)
    summaries = found.select(F.posexplode("dataset_summaries").alias("pos", "r")).select(
        F.lit("dataset_summary").alias("kind"), "pos", F.inline(F.from_json("r.document", "tables array<struct<table_name: string, row_count: bigint>>")["tables"]).alias("item", "n")
    )
    counts = F.from_json("r.document", "processes bigint, datasets bigint")
    entries = F.array(*[F.struct(F.lit(c).alias("item"), counts[c].alias("n")) for c in ("processes", "datasets")])
    snapshots = found.select(F.posexplode("registration_snapshots").alias("pos", "r")).select(F.lit("registration").alias("kind"), "pos", F.inline(entries))
    return summaries.unionByName(snapshots).select("kind", (F.col("pos") + 1).alias("place"), "item", "n")
