"""Plan shapes that must hold at any scale, and results under heavy skew."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from strata.operators import profile, refine

QUERIES = entry_module.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


def test_one_row_per_key_is_kept_before_the_shuffle(spark, sf):
    for name in ("dedup_lineitem", "latest_order_per_customer", "latest_event_per_user", "run_log_newest", "enrich_customer"):
        assert re.search(r"WindowGroupLimit.*Partial", plan_of(QUERIES[name](spark, sf))), name


def test_scans_read_only_what_they_need(spark, sf):
    plan = plan_of(QUERIES["kpi_capped_union"](spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(schemas) == [
        "l_partkey:bigint,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz", "p_partkey:bigint,p_brand:string",
    ]
    plan = plan_of(QUERIES["assets_by_layer"](spark, sf))
    assert "text:string" not in plan


def test_filters_reach_the_scan(spark, sf):
    assert "EqualTo(o_orderstatus,O)" in plan_of(QUERIES["urgent_open_orders"](spark, sf))


def test_gate_shuffles_one_row_per_task(spark, sf):
    plan = plan_of(profile.quality_gate(spark.read.parquet(f"{sf}/lineitem.parquet"), "l"))
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan and "Expand" not in plan


def test_profile_has_no_expand(spark, sf):
    assert "Expand" not in plan_of(QUERIES["profile_lineitem"](spark, sf))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    return spark.range(0, 60_000, numPartitions=8).select(
        key.alias("k"), F.col("id").alias("v"), (F.col("id") % 5).cast("string").alias("kind")
    )


def test_latest_row_of_a_hot_key(skewed):
    got = refine.latest_valid(skewed, "k", "v", None, None, ["kind"])
    assert got.count() == 40_001
    assert got.where("k = 0").first().v == 59_997


def test_dedup_of_a_hot_key_sends_one_row_per_task(spark, skewed):
    kept = refine.dedup(skewed, ["k"], ["v"])
    kept.collect()
    assert kept.where("k = 0").count() == 1


def test_activity_of_a_hot_key(spark, skewed):
    people = spark.createDataFrame([(0,), (1,), (-1,)], "k bigint")
    got = {r.k: r.f for r in refine.activity_flag(people, skewed, "k", "kind", "f", 5).collect()}
    assert got == {0: True, 1: False, -1: False}


def test_lookup_of_a_hot_key_without_broadcast(spark, skewed):
    """A shuffled join on the hot key keeps every row."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dim = skewed.select("k", F.lit("x").alias("name"))
        got = refine.lookup(skewed, dim, "k", ["name"])
        assert got.count() == 60_000 and got.where("name is null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
