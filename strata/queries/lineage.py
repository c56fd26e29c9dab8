"""Lineage over the supply chain: a supplier feeds parts, parts feed an order, an order feeds its customer.

An order is an ETL process. It is recorded in pieces: one record per line with the part as
input, one per order with the customer as output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions.text import DATASET, PROCESS
from strata.operators import lineage
from strata.queries import query, table

SUPPLIER = "'bronze.supplier_' || l_suppkey || '@lake'"
PART = "'silver.part_' || l_partkey || '@lake'"
ORDER = "'etl.order.' || l_orderkey || '@lake'"
CUSTOMER = "'gold.customer_' || o_custkey || '@lake'"

EDGES = f"""edges AS (
    SELECT DISTINCT src, dst FROM (
        SELECT {SUPPLIER} AS src, {PART} AS dst FROM lineitem
        UNION ALL SELECT {PART}, {ORDER} FROM lineitem
        UNION ALL SELECT 'etl.order.' || o_orderkey || '@lake', {CUSTOMER} FROM orders))"""


def _names(kind: str, layer: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{layer}.{kind}_"), F.col(key), F.lit("@lake"))


def _process(key: str) -> F.Column:
    return F.concat(F.lit("etl.order."), key, F.lit("@lake")).alias("qualified_name")


def order_processes(spark, sf_dir) -> DataFrame:
    """Process records of the orders; the pieces of an order share its name, so no join is needed."""
    none = F.array().cast("array<string>")
    lines = table(spark, sf_dir, "lineitem").select(
        _process("l_orderkey"), F.array(_names("part", "silver", "l_partkey")).alias("inputs"), none.alias("outputs")
    )
    orders = table(spark, sf_dir, "orders").select(
        _process("o_orderkey"), none.alias("inputs"), F.array(_names("customer", "gold", "o_custkey")).alias("outputs")
    )
    return lines.unionByName(orders)


def line_processes(spark, sf_dir) -> DataFrame:
    """One whole process record per order line: part in, customer out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(
        _process("l_orderkey"),
        F.array(_names("part", "silver", "l_partkey")).alias("inputs"),
        F.array(_names("customer", "gold", "o_custkey")).alias("outputs"),
    )


def supply_graph(spark, sf_dir, unique: bool = True) -> DataFrame:
    """supplier -> part -> order -> customer."""
    supplied = table(spark, sf_dir, "lineitem").select(
        _names("supplier", "bronze", "l_suppkey").alias("src"), _names("part", "silver", "l_partkey").alias("dst")
    )
    made = lineage.edges(order_processes(spark, sf_dir), unique)
    return (supplied.distinct() if unique else supplied).unionByName(made)


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def lineage_edges(spark, sf_dir):
    return supply_graph(spark, sf_dir)


@query(
    f"""SELECT DISTINCT {PART} AS src, {CUSTOMER} AS dst, {ORDER} AS process
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def lineage_dataset_edges(spark, sf_dir):
    return lineage.dataset_edges(line_processes(spark, sf_dir)).distinct()


ASSETS = """assets AS (
    SELECT 'bronze.supplier_' || s_suppkey || '@lake' AS qualified_name, 'bronze' AS layer FROM supplier
    UNION ALL SELECT 'silver.part_' || p_partkey || '@lake', 'silver' FROM part
    UNION ALL SELECT 'gold.customer_' || c_custkey || '@lake', 'gold' FROM customer)"""


def chain_assets(spark, sf_dir) -> DataFrame:
    def assets(name: str, kind: str, layer: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            _names(kind, layer, key).alias("qualified_name"), F.lit(None).cast("string").alias("layer")
        )

    return (
        assets("supplier", "supplier", "bronze", "s_suppkey")
        .unionByName(assets("part", "part", "silver", "p_partkey"))
        .unionByName(assets("customer", "customer", "gold", "c_custkey"))
    )


@query(
    f"""WITH {EDGES}, {ASSETS}
        SELECT qualified_name, qualified_name IN (SELECT dst FROM edges) AS has_in,
               qualified_name IN (SELECT src FROM edges) AS has_out FROM assets"""
)
def lineage_presence(spark, sf_dir):
    return lineage.has_lineage(chain_assets(spark, sf_dir), supply_graph(spark, sf_dir, unique=False)).drop("layer")


@query(
    f"""WITH {EDGES}, {ASSETS}
        SELECT layer, count(*) AS assets,
               round(count(*) FILTER (qualified_name IN (SELECT dst FROM edges)) / count(*) * 100, 2) AS with_incoming_pct,
               round(count(*) FILTER (qualified_name IN (SELECT src FROM edges)) / count(*) * 100, 2) AS with_outgoing_pct
        FROM assets GROUP BY layer"""
)
def lineage_completeness(spark, sf_dir):
    return lineage.completeness(chain_assets(spark, sf_dir), supply_graph(spark, sf_dir, unique=False))


RICHEST_SUPPLIER = "(SELECT 'bronze.supplier_' || s_suppkey || '@lake' AS node FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1)"
RICHEST_CUSTOMER = "(SELECT 'gold.customer_' || c_custkey || '@lake' AS node FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)"


def _reach_sql(start: str, direction: str, depth: int) -> str:
    here, there = ("src", "dst") if direction == "OUTPUT" else ("dst", "src")
    return f"""WITH RECURSIVE {EDGES}, reach AS (
            SELECT node, 0 AS depth FROM {start}
            UNION SELECT {there}, depth + 1 FROM reach JOIN edges ON node = {here} WHERE depth < {depth})
        SELECT node, CAST(min(depth) AS INTEGER) AS depth, '{direction}' AS direction FROM reach GROUP BY node"""


def _richest(spark, sf_dir, name: str, node: F.Column, balance: str, key: str) -> DataFrame:
    first = table(spark, sf_dir, name).orderBy(F.col(balance).desc(), key).limit(1)
    return first.select(node.alias("node"))


def _supplier(spark, sf_dir) -> DataFrame:
    return _richest(spark, sf_dir, "supplier", _names("supplier", "bronze", "s_suppkey"), "s_acctbal", "s_suppkey")


def _customer(spark, sf_dir) -> DataFrame:
    return _richest(spark, sf_dir, "customer", _names("customer", "gold", "c_custkey"), "c_acctbal", "c_custkey")


@query(_reach_sql(RICHEST_SUPPLIER, "OUTPUT", 3))
def lineage_downstream_3(spark, sf_dir):
    """All that depends on the richest supplier within three steps."""
    return lineage.traverse(supply_graph(spark, sf_dir, unique=False), _supplier(spark, sf_dir), 3, "OUTPUT")


@query(_reach_sql(RICHEST_CUSTOMER, "INPUT", 3))
def lineage_upstream_3(spark, sf_dir):
    """All that the richest customer depends on within three steps."""
    return lineage.traverse(supply_graph(spark, sf_dir, unique=False), _customer(spark, sf_dir), 3, "INPUT")


BEST_PART = "(SELECT 'silver.part_' || p_partkey || '@lake' AS node FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)"


def _best_part(spark, sf_dir) -> DataFrame:
    return _richest(spark, sf_dir, "part", _names("part", "silver", "p_partkey"), "p_retailprice", "p_partkey")


@query(
    f"""SELECT * FROM ({_reach_sql(BEST_PART, "OUTPUT", 2)}) UNION ALL SELECT * FROM ({_reach_sql(BEST_PART, "INPUT", 2)})"""
)
def lineage_both_2(spark, sf_dir):
    return lineage.traverse(supply_graph(spark, sf_dir, unique=False), _best_part(spark, sf_dir), 2, "BOTH")


@query(
    f"""WITH d AS ({_reach_sql(BEST_PART, "OUTPUT", 2)}), u AS ({_reach_sql(BEST_PART, "INPUT", 2)}), {EDGES}
        SELECT src, dst FROM edges WHERE src IN (SELECT node FROM d WHERE depth < 2) OR dst IN (SELECT node FROM u WHERE depth < 2)"""
)
def lineage_relations(spark, sf_dir):
    """The edges that a traversal in both directions walks over."""
    graph = supply_graph(spark, sf_dir, unique=False)
    return lineage.relations(graph, lineage.traverse(graph, _best_part(spark, sf_dir), 2, "BOTH"), 2)


PIPELINE = """CASE o_orderstatus WHEN 'F' THEN 'bronze_to_silver' WHEN 'O' THEN 'silver_to_gold' ELSE NULL END"""


def order_nodes(spark, sf_dir) -> DataFrame:
    """Orders as lineage nodes: processes with a pipeline, with layers, or with a name only; and datasets."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    urgent = priority == "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        F.when(priority == "5-LOW", F.concat(F.lit("silver.order_"), "o_orderkey", F.lit("@lake")))
        .when(urgent, F.concat(F.lit("etl.staging_to_bronze.order_"), "o_orderkey", F.lit("@lake")))
        .otherwise(F.concat(F.lit("etl.other."), "o_orderkey", F.lit("@lake")))
        .alias("qualified_name"),
        F.when(priority != "4-NOT SPECIFIED", F.concat(F.lit("order_"), "o_orderkey")).alias("name"),
        F.when(priority == "5-LOW", DATASET).otherwise(PROCESS).alias("type_name"),
        F.lit(None).cast("string").alias("layer"),
        F.when(status == "F", "bronze_to_silver").when(status == "O", "silver_to_gold").alias("pipeline_name"),
        F.when(priority == "2-HIGH", "bronze").alias("source_layer"),
        F.when(priority == "2-HIGH", "gold").alias("target_layer"),
    )


NODES = f"""nodes AS (
    SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'silver.order_' || o_orderkey WHEN '1-URGENT' THEN 'etl.staging_to_bronze.order_' || o_orderkey
                ELSE 'etl.other.' || o_orderkey END || '@lake' AS qualified_name,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'order_' || o_orderkey END AS name,
           CASE WHEN o_orderpriority = '5-LOW' THEN '{DATASET}' ELSE '{PROCESS}' END AS type_name, {PIPELINE} AS pipeline,
           o_orderpriority AS prio FROM orders),
    described AS (
    SELECT qualified_name, coalesce(name, qualified_name) AS name, type_name, type_name = '{PROCESS}' AS is_process,
           CASE WHEN type_name = '{DATASET}' THEN name WHEN pipeline = 'bronze_to_silver' THEN 'ETL Bronze → Silver'
                WHEN pipeline = 'silver_to_gold' THEN 'ETL Silver → Gold' WHEN name IS NOT NULL THEN replace(name, '_', ' ')
                ELSE 'ETL process' END AS display_name,
           CASE WHEN type_name = '{DATASET}' THEN 'silver' WHEN pipeline = 'bronze_to_silver' THEN 'etl-bronze-silver'
                WHEN pipeline = 'silver_to_gold' THEN 'etl-silver-gold' WHEN prio = '2-HIGH' THEN 'etl-bronze-gold'
                WHEN prio = '1-URGENT' THEN 'etl-staging-bronze' ELSE 'etl' END AS layer FROM nodes)"""


@query(
    f"""WITH {NODES} SELECT *, CASE layer WHEN 'silver' THEN 'Silver' WHEN 'etl' THEN 'ETL' WHEN 'etl-staging-bronze' THEN 'ETL · Staging→Bronze'
                                 WHEN 'etl-bronze-silver' THEN 'ETL · Bronze→Silver' WHEN 'etl-silver-gold' THEN 'ETL · Silver→Gold'
                                 ELSE layer END AS layer_label FROM described"""
)
def lineage_nodes(spark, sf_dir):
    return lineage.describe_nodes(order_nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT layer, count(*) AS nodes FROM described WHERE NOT is_process GROUP BY layer")
def lineage_nodes_by_layer(spark, sf_dir):
    return lineage.nodes_by_layer(lineage.describe_nodes(order_nodes(spark, sf_dir)))


@query(f"WITH {NODES} SELECT qualified_name FROM nodes WHERE pipeline = 'silver_to_gold'")
def lineage_edge_processes(spark, sf_dir):
    """Processes on the arrow from silver to gold."""
    return lineage.processes_of_edge(order_nodes(spark, sf_dir), "silver_to_gold").select("qualified_name")




@query(
    """SELECT DISTINCT 'etl.silver_to_gold.fact_' || o_orderstatus || '@lake' AS process,
              CASE o_orderstatus WHEN 'F' THEN 'bronze.raw_orders@lake' WHEN 'O' THEN 'silver.nation@lake' END AS input,
              'gold.fact_' || o_orderstatus || '@lake' AS output
       FROM orders WHERE o_orderstatus <> 'P'
       UNION SELECT DISTINCT 'etl.silver_to_gold.fact_' || o_orderstatus || '@lake', 'silver.silver_orders@lake',
              'gold.fact_' || o_orderstatus || '@lake' FROM orders WHERE o_orderstatus <> 'P'"""
)
def lineage_registration(spark, sf_dir):
    """Gold processes of tables with raw, refined, unprefixed and generated sources."""
    statuses = table(spark, sf_dir, "orders").select("o_orderstatus").distinct()
    own = (
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("raw_orders"), F.lit("silver_orders")))
        .when(F.col("o_orderstatus") == "O", F.array(F.lit("nation"), F.lit("silver_orders")))
        .otherwise(F.array(F.lit("generated"), F.lit("all_iku_facts")))
    )
    profiles = statuses.select(F.concat(F.lit("fact_"), "o_orderstatus").alias("table_name"), own.alias("sources"))
    made = lineage.gold_processes(profiles, "lake", "2024-07-01T00:00:00Z")
    return made.select(
        F.col("qualified_name").alias("process"), F.explode("inputs").alias("input"), F.col("outputs")[0].alias("output")
    )
