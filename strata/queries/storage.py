"""Sinks and sources: whole tables written to the shared folder and read back, and a layer run over them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from strata.functions.dates import year_of
from strata.functions.predicates import at_least
from strata.operators import kpi, profile, refine, runs
from strata.plans.layers import Curated, Lake, Refined, Tables, append_bronze, run_bronze, run_gold, run_silver
from strata.queries import query, table
from strata.queries.kpis import FALLBACK, TARGETS
from strata.sources import read, runlog, write
from strata.sources.scratch import new_folder


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
              CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer"""
)
def csv_roundtrip(spark, sf_dir):
    """Customers exported as headered CSV and read as raw text; blank fields come back as NULL."""
    path = new_folder(spark, "csv")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", segment.alias("c_mktsegment"))
    write.export_csv(customers, path)
    return read.read_staging(spark, path)


@query(
    """SELECT 'documents' AS table_name, count(*) AS row_count FROM documents
       UNION ALL SELECT 'conversations', count(*) FROM conversations
       UNION ALL SELECT 'nothing', 0"""
)
def csv_summary(spark, sf_dir):
    """Records of CSV tables whose quoted texts hold line breaks, quotes and commas; one table has a header only."""
    folder = new_folder(spark, "csv")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit('a "b",\n'), "source").alias("note"))
    conversations = table(spark, sf_dir, "conversations")
    for name, frame in {"documents": documents, "conversations": conversations, "nothing": conversations.where("false")}.items():
        frame.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return read.dataset_summary(spark, folder).select("table_name", "row_count")


@query("SELECT event_id, user_id, event_type, props FROM events")
def json_roundtrip(spark, sf_dir):
    path = new_folder(spark, "json")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    write.export_json(events, path)
    return spark.read.schema(events.schema).json(path)


@query("SELECT s_suppkey, s_name, s_acctbal, s_acctbal < 0 AS is_debtor FROM supplier")
def replace_roundtrip(spark, sf_dir):
    """A table that is replaced by one with another schema."""
    path = new_folder(spark, "table")
    supplier = table(spark, sf_dir, "supplier")
    write.replace_files(supplier.select("s_suppkey"), path)
    debtor = (F.col("s_acctbal") < 0).alias("is_debtor")
    return write.replace_files(supplier.select("s_suppkey", "s_name", "s_acctbal", debtor), path)


@query(
    """SELECT 'load_events' AS pipeline, CAST(2 AS BIGINT) AS tables_total, CAST(1 AS BIGINT) AS tables_written,
              count(*) AS rows_written, CAST(2.5 AS DOUBLE) AS duration_sec FROM events"""
)
def run_log_roundtrip(spark, sf_dir):
    """Two runs over the events are recorded; the later one is the latest."""
    folder = new_folder(spark, "runs")
    results = {
        "events": {"row_count": table(spark, sf_dir, "events").count(), "status": "PASS", "written": True},
        "rejected": {"row_count": 0, "status": "REJECT", "written": False},
    }
    for day, seconds in enumerate((1.0, 2.5), 1):
        begun = datetime(2024, 7, day, tzinfo=timezone.utc)
        record = runlog.run_record(spark, "load_events", results, begun, begun + timedelta(seconds=seconds))
        runlog.append_run(record, folder)
    latest = runs.latest_runs(runlog.read_runs(spark, folder), tiebreak=("started_at",))
    return latest.select("pipeline", "tables_total", "tables_written", "rows_written", "duration_sec")


def _silver_orders(t: Tables, as_of: str) -> DataFrame:
    flags = {"is_fulfilled": "F", "is_pending": "P"}
    flagged = refine.status_flags(
        t["raw_orders"], "o_orderstatus", flags, "is_processed", "o_orderkey", ["o_orderdate", "o_custkey"]
    )
    return flagged.withColumn("is_big", at_least("o_totalprice", 250000))


def _fact(t: Tables) -> DataFrame:
    targets = kpi.target_table(t["silver_orders"].sparkSession, TARGETS)
    return kpi.outcome_share(
        t["silver_orders"].withColumn("year", year_of("o_orderdate")),
        kpi.Kpi("OUT", "processed_pct", targets, FALLBACK, floor=None),
        "year",
        "o_orderpriority",
        "total",
        {"fulfilled": "is_fulfilled", "pending": "is_pending"},
        ("remaining", "is_processed"),
    )


def refreshed(spark, sf_dir) -> tuple[Lake, str]:
    """Orders exported as raw CSV, then loaded, refined and curated in a lake of their own.

    A second raw file is missing, so its refined table fails and the rest goes on.
    """
    base = new_folder(spark, "lake")
    raw = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    write.export_csv(raw, f"{base}/landing/raw_orders.csv")
    lake, log = Lake(spark, f"{base}/lake"), f"{base}/runs"
    run_bronze(lake, f"{base}/landing", {"raw_orders": ["o_custkey"], "raw_gone": []}, log)
    recipes = [
        Refined("silver_orders", ["raw_orders"], ["raw_orders"], ["FLAG", "DEDUP"], _silver_orders),
        Refined("silver_gone", ["raw_gone"], ["raw_gone"], ["none"], lambda t, as_of: t["raw_gone"]),
    ]
    run_silver(lake, recipes, "2001-06-01", log)
    fact = Curated("fact_orders", "fact", ["silver_orders"], _fact, "processed_pct", target="target", attainment="attainment")
    run_gold(lake, [fact], run_folder=log)
    return lake, log


_GROUPS = "(SELECT count(*) FROM (SELECT DISTINCT year(o_orderdate), o_orderpriority FROM orders))"


@query(
    f"""SELECT 'staging_to_bronze' AS pipeline, CAST(1 AS BIGINT) AS tables_total, CAST(1 AS BIGINT) AS tables_written,
               count(*) AS rows_written FROM orders
        UNION ALL SELECT 'bronze_to_silver', 2, 1, count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 'silver_to_gold', 1, 1, {_GROUPS}"""
)
def layer_refresh(spark, sf_dir):
    """Run records of a refresh of three layers."""
    _, log = refreshed(spark, sf_dir)
    return read_log(spark, log)


def read_log(spark, log: str) -> DataFrame:
    return runlog.read_runs(spark, log).select("pipeline", "tables_total", "tables_written", "rows_written")


@query(
    """SELECT CAST(year(o_orderdate) * 100 + 12 AS INTEGER) AS period_key, o_orderpriority, count(*) AS total,
              count(*) FILTER (o_orderstatus = 'F') AS fulfilled, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS remaining
       FROM orders GROUP BY ALL"""
)
def layer_refresh_fact(spark, sf_dir):
    """The curated fact of that refresh, from text columns end to end."""
    lake, _ = refreshed(spark, sf_dir)
    return lake.read("gold", "fact_orders").select("period_key", "o_orderpriority", "total", "fulfilled", "remaining")


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_LATE_ORDERS = "CASE WHEN o_orderkey % 3 = 0 AND o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END"


@query(
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({v}) AS null_count,
                   round((count(*) - count({v})) / count(*) * 100, 2) AS null_pct, round(count({v}) / count(*) * 100, 2) AS completeness_pct,
                   true AS distinct_in_bound FROM orders"""
        for c in _ORDER_COLUMNS
        for v in [_LATE_ORDERS if c == "o_orderpriority" else c]
    )
)
def layer_refresh_after_append(spark, sf_dir):
    """The profile of a raw table that was loaded in three batches, one of them twice; each batch was sketched alone.

    Counts are those of a full profile. Distinct values are within four standard errors of the exact ones, which the
    query takes from the loaded table.
    """
    base = new_folder(spark, "lake")
    day, priority = F.date_format("o_orderdate", "yyyy-MM-dd"), F.when((F.col("o_orderkey") % 3 != 0) | (F.col("o_orderpriority") != "5-LOW"), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS).withColumns({"o_orderdate": day, "o_orderpriority": priority})
    lake = Lake(spark, f"{base}/lake")
    for batch in (0, 1, 2):
        write.export_csv(orders.where(F.col("o_orderkey") % 3 == batch), f"{base}/landing{batch}/raw_orders.csv")
    for batch in (0, 1, 1, 2):
        run = append_bronze(lake, f"{base}/landing{batch}", {"raw_orders": ["o_custkey"]}, f"day{batch}")
    merged = run.profiles.select(F.explode(F.map_entries("columns")).alias("entry"), "row_count")
    exact = profile.profile_columns(lake.read("bronze", "raw_orders"), "raw_orders").select("column_name", F.col("distinct_count").alias("exact"))
    found = merged.select(F.col("entry.key").alias("column_name"), "row_count", "entry.value.*")
    bound = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1), 4 * 0.0163 * F.col("exact"))
    return found.join(exact, "column_name").select("column_name", "row_count", "null_count", "null_pct", "completeness_pct", bound.alias("distinct_in_bound"))


@query(
    """SELECT 'staging_to_bronze' AS pipeline, CAST(2 AS BIGINT) AS tables_total, CAST(2 AS BIGINT) AS tables_written,
              2 * count(*) AS rows_written FROM orders
       UNION ALL SELECT 'bronze_to_silver', 3, 2, 2 * count(*) FROM orders"""
)
def layer_refresh_rejected(spark, sf_dir):
    """Run records of a refresh in which one refined table is rejected for its mostly blank source, one is written all the same."""
    base = new_folder(spark, "lake")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    blank = [F.col("o_orderkey"), *[F.lit("  ").alias(c) for c in orders.columns[1:]]]
    write.export_csv(orders, f"{base}/landing/raw_orders.csv")
    orders.select(*blank).write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/landing/raw_blank.csv")
    lake, log = Lake(spark, f"{base}/lake"), f"{base}/runs"
    run_bronze(lake, f"{base}/landing", {"raw_orders": [], "raw_blank": []}, log)
    keys = lambda name: lambda t, as_of: t[name].select("o_orderkey")
    recipes = [
        Refined("silver_orders", ["raw_orders"], ["raw_orders"], ["KEYS"], keys("raw_orders")),
        Refined("silver_blank", ["raw_blank"], ["raw_blank"], ["KEYS"], keys("raw_blank")),
        Refined("silver_reported", ["raw_blank"], ["raw_blank"], ["KEYS"], keys("raw_blank"), gate="report"),
    ]
    run_silver(lake, recipes, "2001-06-01", log)
    return read_log(spark, log)
