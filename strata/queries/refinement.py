"""Clean, enriched and latest rows; dimensions; paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions.text import label
from strata.operators import catalog, dims, refine, runs
from strata.queries import query, table

REGIONS = {0: "Africa", 1: "America", 2: "Asia", 3: "Europe", 4: "Middle East"}
REGION_CASE = "CASE n_regionkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in REGIONS.items()) + " END"
STATUS_FLAGS = {"is_fulfilled": "F", "is_open": "O", "is_pending": "P"}
AS_OF = "2001-06-01"


def orders_with_flags(spark, sf_dir) -> DataFrame:
    flags = {k: STATUS_FLAGS[k] for k in ("is_fulfilled", "is_pending")}
    order = ["o_orderdate", "o_custkey", "o_orderstatus"]
    return refine.status_flags(
        table(spark, sf_dir, "orders"), "o_orderstatus", flags, "is_processed", "o_orderkey", order
    )


@query(
    f"""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_name, n_regionkey,
               {REGION_CASE} AS region_label, c_acctbal >= 5000 AS is_premium
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def enrich_customer(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return refine.enrich_lookup(
        table(spark, sf_dir, "customer"),
        nation,
        on="c_nationkey",
        dim_columns=["n_name", "n_regionkey"],
        labels={"region_label": ("n_regionkey", REGIONS)},
        flags={"is_premium": F.col("c_acctbal") >= 5000},
        key="c_custkey",
    )


@query(
    """SELECT o_orderkey, o_orderstatus, o_orderstatus = 'F' AS is_fulfilled, o_orderstatus = 'P' AS is_pending,
              o_orderstatus IN ('F', 'P') AS is_processed
       FROM orders"""
)
def order_status_flags(spark, sf_dir):
    return orders_with_flags(spark, sf_dir).select(
        "o_orderkey", "o_orderstatus", "is_fulfilled", "is_pending", "is_processed"
    )


@query(
    """SELECT c_custkey, coalesce(kinds, 0) >= 5 AS buys_all_priorities
       FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds
                                FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
)
def customer_activity(spark, sf_dir):
    activity = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return refine.activity_flag(
        table(spark, sf_dir, "customer"), activity, "c_custkey", "o_orderpriority", "buys_all_priorities", 5, order=[]
    ).select("c_custkey", "buys_all_priorities")


@query(
    """SELECT c_custkey, coalesce(kinds, 0) >= 1 AS has_events
       FROM customer LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds
                                FROM events GROUP BY user_id) ON c_custkey = user_id"""
)
def customer_has_events(spark, sf_dir):
    """Entities without any activity get false."""
    activity = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    return refine.activity_flag(
        table(spark, sf_dir, "customer"), activity, "c_custkey", "event_type", "has_events", order=[]
    ).select("c_custkey", "has_events")


@query(
    """SELECT 'C' || c_custkey AS party_id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance,
              'Customer' AS kind, c_acctbal < 0 AS is_debtor FROM customer
       UNION ALL
       SELECT 'S' || s_suppkey, s_name, s_nationkey, s_acctbal, 'Supplier', s_acctbal < 0 FROM supplier"""
)
def party_union(spark, sf_dir):
    def columns(prefix: str, key: str, letter: str) -> dict:
        return {
            "party_id": F.concat(F.lit(letter), key),
            "name": f"{prefix}_name",
            "nation_id": f"{prefix}_nationkey",
            "balance": f"{prefix}_acctbal",
            "is_debtor": F.col(f"{prefix}_acctbal") < 0,
        }

    customer = (table(spark, sf_dir, "customer"), columns("c", "c_custkey", "C"), "Customer")
    supplier = (table(spark, sf_dir, "supplier"), columns("s", "s_suppkey", "S"), "Supplier")
    return refine.union_normalise([customer, supplier], kind="kind", key="party_id")


@query(
    """SELECT o_orderkey, o_custkey, o_orderpriority, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_hurried
       FROM orders WHERE o_orderstatus = 'O'"""
)
def urgent_open_orders(spark, sf_dir):
    return refine.filter_flag(
        table(spark, sf_dir, "orders"),
        F.col("o_orderstatus") == "O",
        "is_hurried",
        "o_orderpriority",
        ["1-URGENT", "2-HIGH"],
        "o_orderkey",
        order=["o_custkey", "o_orderpriority"],
    ).select("o_orderkey", "o_custkey", "o_orderpriority", "is_hurried")


@query(
    f"""SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice >= 250000 AS is_large
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
              FROM orders WHERE CAST(o_orderdate AS DATE) + 180 >= DATE '{AS_OF}')
        WHERE rn = 1"""
)
def latest_order_per_customer(spark, sf_dir):
    """Newest order per customer among those placed in the last 180 days."""
    orders = table(spark, sf_dir, "orders").withColumn("valid_until", F.date_add(F.to_date("o_orderdate"), 180))
    latest = refine.latest_valid(
        orders, "o_custkey", "o_orderdate", "valid_until", AS_OF, ["o_orderkey"],
        {"is_large": F.col("o_totalprice") >= 250000},
    )
    return latest.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "is_large")


@query(
    """SELECT user_id, event_id, event_type, value
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events)
       WHERE rn = 1"""
)
def latest_event_per_user(spark, sf_dir):
    latest = refine.latest_valid(table(spark, sf_dir, "events"), "user_id", "ts", None, None, ["event_id"])
    return latest.select("user_id", "event_id", "event_type", "value")


LINE = (
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE)}) AS rn
              FROM lineitem) WHERE rn = 1"""
)
def dedup_lineitem(spark, sf_dir):
    """The natural key repeats; the smallest remaining values survive."""
    kept = refine.dedup(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], list(LINE))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_sourcing(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25"""
)
def top_orders_page(spark, sf_dir):
    """Page 2 of 25."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return catalog.page_number(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 2, 25)


LINE_ORDER = "l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
        ORDER BY {LINE_ORDER} LIMIT 5 OFFSET 49995"""
)
def lineitem_page_10000(spark, sf_dir):
    """Page 10,000 of 5, found by counts per range."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return catalog.page(lines, order, 5, 9999 * 5, deep=10_000)


@query(
    """WITH last AS (SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 999)
       SELECT o.o_orderkey, o.o_totalprice FROM orders o, last
       WHERE o.o_totalprice < last.o_totalprice OR o.o_totalprice = last.o_totalprice AND o.o_orderkey > last.o_orderkey
       ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 25"""
)
def orders_after_key(spark, sf_dir):
    """The page after the thousandth order, by its key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    last = catalog.page(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 1, 999).first()
    return catalog.page_after(orders, [("o_totalprice", True), ("o_orderkey", False)], (last.o_totalprice, last.o_orderkey), 25)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 3")
def newest_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = catalog.page(events, [F.col("ts").desc(), "event_id"], 3)
    return newest.select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def customers_sorted(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return catalog.sort_by(customers, "c_acctbal", ascending=False, tiebreak=["c_custkey"])


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
              CAST(NULL AS INTEGER) AS o_orderpriority, o_totalprice >= 100000 AS is_big
       FROM orders"""
)
def conform_orders(spark, sf_dir):
    """All-string orders back to types; a text that is no number becomes NULL."""
    raw = table(spark, sf_dir, "orders")
    raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    types = {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double",
        "o_orderdate": "date", "o_orderpriority": "int",
    }
    typed = refine.conform(raw, types)
    return typed.select(*types, (F.col("o_totalprice") >= 100000).alias("is_big"))


MONTH_CASE = (
    "CASE m " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(dims.MONTHS, 1)) + " END"
)


@query(
    f"""WITH span AS (SELECT year(min(o_orderdate)) AS y0, year(max(o_orderdate)) AS y1 FROM orders),
        months AS (SELECT CAST(y.y AS INTEGER) AS y, CAST(m.m AS INTEGER) AS m,
                          CAST((y.y - y0) * 12 + m.m AS INTEGER) AS calendar_id
                   FROM span, unnest(range(y0, y1 + 1)) AS y(y), unnest(range(1, 13)) AS m(m)),
        sold AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS k, count(*) AS n
                 FROM orders GROUP BY 1)
        SELECT calendar_id, y * 100 + m AS period_key, y AS year, CASE WHEN m >= 8 OR m <= 1 THEN 'Ganjil'
               ELSE 'Genap' END AS term, CAST(ceil(m / 3) AS INTEGER) AS quarter, m AS month,
               {MONTH_CASE} AS month_name, coalesce(n, 0) AS orders
        FROM months LEFT JOIN sold ON k = y * 100 + m"""
)
def dim_calendar(spark, sf_dir):
    """The months the orders span, with the number of orders of each."""
    orders = table(spark, sf_dir, "orders")
    calendar = dims.calendar_dimension(dims.year_range(orders, "o_orderdate"))
    key = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("period_key")
    sold = orders.groupBy(key).agg(F.count(F.lit(1)).alias("orders"))
    return calendar.join(sold, "period_key", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


TYPES = {"STANDARD": "Regular", "ECONOMY": "Low cost", "PROMO": "Campaign", "LARGE": "Bulk"}
TYPE_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"


@query(
    f"""SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand, {TYPE_CASE} AS type_label,
               'catalogue' AS origin, p_retailprice AS price FROM part"""
)
def dim_part(spark, sf_dir):
    """Labelled, renamed, with a constant; types without a label get NULL."""
    columns = {
        "part_id": "p_partkey",
        "part_name": "p_name",
        "brand": "p_brand",
        "type_label": label("p_type", TYPES),
        "origin": F.lit("catalogue"),
        "price": "p_retailprice",
    }
    return dims.mapped_dimension(table(spark, sf_dir, "part"), "part_id", columns)


@query(f"SELECT n_nationkey AS nation_id, n_name AS nation, {REGION_CASE} AS region FROM nation")
def dim_nation(spark, sf_dir):
    columns = {"nation_id": "n_nationkey", "nation": "n_name", "region": label("n_regionkey", REGIONS)}
    return dims.mapped_dimension(table(spark, sf_dir, "nation"), "nation_id", columns)


@query("SELECT c_custkey AS customer_id, c_nationkey AS nation_id, c_mktsegment AS segment FROM customer")
def dim_customer(spark, sf_dir):
    columns = {"customer_id": "c_custkey", "nation_id": "c_nationkey", "segment": "c_mktsegment"}
    return dims.mapped_dimension(table(spark, sf_dir, "customer"), "customer_id", columns)


RUNS = """(SELECT event_type AS pipeline, ts AS ended_at, event_id, CAST(value AS DECIMAL(18,3)) AS duration_sec
          FROM events) runs"""


def _runs(spark, sf_dir) -> DataFrame:
    """Run records derived from the events: type as pipeline, time as end, value as duration."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pipeline"),
        F.col("ts").alias("ended_at"),
        "event_id",
        F.col("value").cast("decimal(18,3)").alias("duration_sec"),
    )


@query(
    f"""SELECT pipeline, event_id, CAST(duration_sec AS DOUBLE) AS duration_sec FROM (
            SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ended_at DESC, event_id) AS rn FROM {RUNS})
        WHERE rn = 1"""
)
def run_log_latest(spark, sf_dir):
    latest = runs.latest_runs(_runs(spark, sf_dir), tiebreak=("event_id",))
    return latest.select("pipeline", "event_id", F.col("duration_sec").cast("double").alias("duration_sec"))


@query(
    f"""SELECT pipeline, event_id FROM (
            SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ended_at DESC, event_id) AS rn FROM {RUNS})
        WHERE rn <= 3"""
)
def run_log_newest(spark, sf_dir):
    return runs.newest(_runs(spark, sf_dir), 3, tiebreak=("event_id",)).select("pipeline", "event_id")


@query(
    f"""SELECT count(*) AS pipelines, CAST(sum(duration_sec) AS DOUBLE) AS runtime_total_sec FROM (
            SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ended_at DESC, event_id) AS rn FROM {RUNS})
        WHERE rn = 1"""
)
def run_log_runtime(spark, sf_dir):
    return runs.total_runtime(runs.latest_runs(_runs(spark, sf_dir), tiebreak=("event_id",)))
