"""Lineage: registration rules, traversal on awkward graphs, completeness."""

import random

import pytest

from strata.operators import lineage


@pytest.fixture
def graph(spark):
    return lambda pairs: spark.createDataFrame(pairs, "src string, dst string")


@pytest.fixture
def start(spark):
    return lambda *nodes: spark.createDataFrame([(n,) for n in nodes], "node string")


def test_gold_inputs(spark, rows):
    profiles = spark.createDataFrame(
        [("d", ["generated"]), ("r", ["all_iku_facts"]), ("f", ["raw_x", "silver_y", "z"])], "table_name string, sources array<string>"
    )
    made = lineage.gold_processes(profiles, "l", "now").collect()
    assert [(p.qualified_name, p.inputs, p.outputs) for p in made] == [
        ("etl.silver_to_gold.f@l", ["bronze.raw_x@l", "silver.silver_y@l", "silver.z@l"], ["gold.f@l"])
    ]


def test_silver_and_bronze_processes(spark, rows):
    profiles = spark.createDataFrame([("s", ["a", "b"], ["x", "y"])], "table_name string, sources array<string>, transformations array<string>")
    made = lineage.silver_processes(profiles, "l", "now")
    assert made.first().description == "a + b → s\nTransformations: x; y"
    assert rows(lineage.edges(made)) == [
        ("bronze.a@l", "etl.bronze_to_silver.s@l"), ("bronze.b@l", "etl.bronze_to_silver.s@l"),
        ("etl.bronze_to_silver.s@l", "silver.s@l"),
    ]
    bronze = lineage.bronze_processes(profiles, "l", "now").first()
    assert (bronze.inputs, bronze.outputs, bronze.source_layer) == (["staging.s@l"], ["bronze.s@l"], "staging")
    assert rows(lineage.dataset_edges(made), "src", "dst") == [("bronze.a@l", "silver.s@l"), ("bronze.b@l", "silver.s@l")]


def test_traversal_of_a_cycle(graph, start, rows):
    loop = graph([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")])
    assert rows(lineage.traverse(loop, start("a"), 9, "OUTPUT"), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    both = lineage.traverse(loop, start("d"), 1)
    assert rows(both, "node", "depth", "direction") == [("c", 1, "INPUT"), ("d", 0, "INPUT"), ("d", 0, "OUTPUT")]
    assert rows(lineage.relations(loop, both, 1)) == [("c", "d")]


def test_depth_zero_and_unknown_start(graph, start, rows):
    g = graph([("a", "b")])
    assert rows(lineage.traverse(g, start("a"), 0, "OUTPUT"), "node", "depth") == [("a", 0)]
    assert rows(lineage.traverse(g, start("zz"), 3, "OUTPUT"), "node", "depth") == [("zz", 0)]
    with pytest.raises(ValueError):
        lineage.traverse(g, start("a"), 1, "UP")


@pytest.mark.parametrize("limit", [lineage.BROADCAST_BYTES, 0])
def test_traversal_against_brute_force(graph, start, rows, monkeypatch, limit):
    """Same result with broadcast frontiers and with shuffled ones, on a graph with a hub."""
    monkeypatch.setattr(lineage, "BROADCAST_BYTES", limit)
    rnd = random.Random(7)
    pairs = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(40)] + [("n1", "hub")]
    depth_of, level = {"n1": 0}, {"n1"}
    for depth in range(1, 4):
        level = {d for s, d in pairs if s in level} - set(depth_of)
        depth_of |= dict.fromkeys(level, depth)
    got = dict(rows(lineage.traverse(graph(pairs), start("n1"), 3, "OUTPUT"), "node", "depth"))
    assert got == depth_of


def test_completeness(spark, graph, rows):
    assets = spark.createDataFrame([("bronze.a", None), ("bronze.b", None), ("silver.c", None), ("x", None)], "qualified_name string, layer string")
    got = lineage.completeness(assets, graph([("bronze.a", "p"), ("p", "silver.c"), ("bronze.a", "q")]))
    assert rows(got) == [("bronze", 2, 0.0, 50.0), ("gold", 0, 0.0, 0.0), ("silver", 1, 100.0, 0.0)]


def test_edge_filter(spark):
    columns = "qualified_name string, pipeline_name string, source_layer string, target_layer string"
    processes = spark.createDataFrame(
        [("a", "silver_to_gold", None, None), ("b", None, "silver", "gold"), ("c", "x", "bronze", "gold"), ("d", None, None, None)], columns
    )
    assert [r.qualified_name for r in lineage.processes_of_edge(processes, "silver_to_gold").collect()] == ["a", "b"]


def test_checkpoint_folder_of_the_cluster_is_used(spark, tmp_path):
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path))
        lineage.ensure_checkpoint_dir(spark)
        assert str(tmp_path) in context.getCheckpointDir()
        spark.conf.unset("spark.checkpoint.dir")
    before = context.getCheckpointDir()
    lineage.ensure_checkpoint_dir(spark)
    assert context.getCheckpointDir() == before


def test_edges_are_written_once_and_never_shuffled_again(spark, graph, start, rows):
    """A hub's edges lie in several buckets; a large frontier joins them without an exchange of the edges."""
    hub = graph([("hub", f"n{i}") for i in range(400)] + [("hub", "n1"), ("n1", "z")])
    with lineage.adjacency(hub, 8) as edges:
        assert edges.count() == 401 and edges.where("src = 'hub'").select("salt").distinct().count() == lineage.SALTS
        frontier = spark.createDataFrame([("hub", s) for s in range(lineage.SALTS)], "src string, salt int").hint("merge")
        joined = edges.join(frontier, ["src", "salt"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("strata_adjacency") - 400 : plan.index("strata_adjacency")]
        assert joined.count() == 400 and "hashpartitioning(src" in plan and plan.count("Exchange") == 1, scan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("strata_adjacency")]
    for written in (True, False):
        assert len(rows(lineage.traverse(hub, start("hub"), 3, "OUTPUT", written), "node", "depth")) == 402
