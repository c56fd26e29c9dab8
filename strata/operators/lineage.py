"""Lineage: ETL processes, the edges they imply, traversal and completeness.

Scale notes
-----------
* Edges are an exploded projection of the processes, no per-asset calls.
* Traversal is breadth first. The edges are derived once and written as they come. A level
  joins the frontier (one row per node) with them: a small frontier, by measured bytes, is
  broadcast, so the edges are only scanned. At the first large one an adjacency table is
  written, each edge one time, bucketed by the end that the traversal starts from and a salt,
  so that a hub with a third of the edges lies in many buckets; a large frontier is dealt to
  the buckets, once for every salt, and the edges are not shuffled again. The level's nodes are merged map-side and nodes seen before dropped. Each level is
  checkpointed, so lost executors cost one level and the plan does not grow with the depth.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.numbers import share_pct
from strata.functions.text import LAYERS, PROCESS, layer_from_name, layer_of, process_name, qualified_name
from strata.sources.scratch import ensure_checkpoint_dir, new_folder


def _processes(
    tables: DataFrame, pipeline: str, cluster: str, inputs: Column, description: Column, as_of: str, engine: str
) -> DataFrame:
    source, target = pipeline.split("_to_")
    name = F.col("table_name")
    return tables.select(
        process_name(pipeline, name, cluster).alias("qualified_name"),
        F.concat(F.lit(f"{pipeline}_"), name).alias("name"),
        F.lit(PROCESS).alias("type_name"),
        description.alias("description"),
        F.lit(pipeline).alias("pipeline_name"),
        F.lit(source).alias("source_layer"),
        F.lit(target).alias("target_layer"),
        F.lit(engine).alias("engine"),
        F.lit(as_of).alias("run_timestamp"),
        inputs.alias("inputs"),
        F.array(qualified_name(target, name, cluster)).alias("outputs"),
    )


def bronze_processes(tables: DataFrame, cluster: str, as_of: str, engine: str = "spark") -> DataFrame:
    """staging -> bronze, one input each; ``tables`` has ``table_name``."""
    inputs = F.array(qualified_name("staging", "table_name", cluster))
    text = F.concat(F.lit("Load raw file into table "), "table_name")
    return _processes(tables, "staging_to_bronze", cluster, inputs, text, as_of, engine)


def silver_processes(profiles: DataFrame, cluster: str, as_of: str, engine: str = "spark") -> DataFrame:
    """bronze -> silver, one input per source; needs ``sources`` and ``transformations``."""
    inputs = F.transform("sources", lambda s: qualified_name("bronze", s, cluster))
    text = F.concat(
        F.array_join("sources", " + "), F.lit(" → "), "table_name",
        F.lit("\nTransformations: "), F.array_join("transformations", "; "),
    )
    return _processes(profiles, "bronze_to_silver", cluster, inputs, text, as_of, engine)


def gold_processes(profiles: DataFrame, cluster: str, as_of: str, engine: str = "spark") -> DataFrame:
    """Sources -> gold. A raw source is bronze, any other is silver.

    Generated tables and the summary over all facts have no inputs and no process.
    """
    real = F.filter("sources", lambda s: ~s.isin("generated", "all_iku_facts"))
    layer = lambda s: F.when(s.startswith("raw_"), F.lit("bronze")).otherwise(F.lit("silver"))
    inputs = F.transform(real, lambda s: qualified_name(layer(s), s, cluster))
    text = F.concat(
        F.lit("Star schema aggregation: "), F.array_join("sources", ", "), F.lit(" → gold."), "table_name"
    )
    made = _processes(profiles, "silver_to_gold", cluster, inputs, text, as_of, engine)
    return made.where(F.size("inputs") > 0)


def edges(processes: DataFrame, unique: bool = True) -> DataFrame:
    """Directed edges input -> process -> output.

    Traversal tolerates repeated edges, so ``unique=False`` saves it a shuffle of all edges.
    """
    into = processes.select(F.explode("inputs").alias("src"), F.col("qualified_name").alias("dst"))
    out = processes.select(F.col("qualified_name").alias("src"), F.explode("outputs").alias("dst"))
    both = into.unionByName(out)
    return both.distinct() if unique else both


def dataset_edges(processes: DataFrame) -> DataFrame:
    """Directed edges input -> output, labelled with their process."""
    return processes.select(
        F.explode("inputs").alias("src"), "outputs", F.col("qualified_name").alias("process")
    ).select("src", F.explode("outputs").alias("dst"), "process")


# A frontier is broadcast if its names have at most this many bytes, counted with ``NODE_BYTES`` more for each.
BROADCAST_BYTES = 10 * 1024 * 1024
NODE_BYTES = 32
SALTS = 16  # parts of a node's edges in an adjacency table


def _size(nodes: DataFrame) -> tuple[int, int]:
    """How many nodes there are, and about how many bytes they take in memory."""
    names = F.coalesce(F.sum(F.octet_length("node").cast("long") + NODE_BYTES), F.lit(0))
    return tuple(nodes.agg(F.count(F.lit(1)), names).first())


def _sized(nodes: DataFrame, size: int) -> DataFrame:
    return F.broadcast(nodes) if size <= BROADCAST_BYTES else nodes


@contextmanager
def written_edges(graph: DataFrame) -> Iterator[DataFrame]:
    """The edges as rows of a Parquet table in the shared folder, deleted when the block ends."""
    spark = graph.sparkSession
    path = new_folder(spark, "edges")
    try:
        graph.select("src", "dst").write.parquet(path)
        yield spark.read.schema("src string, dst string").parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def adjacency(graph: DataFrame, buckets: int | None = None) -> Iterator[DataFrame]:
    """The distinct edges of ``graph`` as a table bucketed by ``src`` and ``salt``, dropped when the block ends."""
    spark = graph.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"strata_adjacency_{uuid.uuid4().hex}"
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")
    edges = graph.select("src", "dst").distinct().withColumn("salt", salt).repartition(count, "src", "salt")
    try:
        edges.write.format("parquet").bucketBy(count, "src", "salt").sortBy("src", "salt").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _reach(graph: DataFrame, start: DataFrame, depth: int, kept: ExitStack | None) -> DataFrame:
    """Nodes within ``depth`` steps along src -> dst, with their smallest depth; the start has depth 0.

    ``kept`` holds the adjacency table that the first large frontier asks for; without it every level shuffles the edges.
    """
    frontier = start.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    visited, (found, size) = frontier, _size(frontier)
    seen, bucketed = size, None
    for level in range(1, depth + 1):
        sources = frontier.select(F.col("node").alias("src"))
        if kept is not None and size > BROADCAST_BYTES:
            bucketed = kept.enter_context(adjacency(graph)) if bucketed is None else bucketed
            salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
            joined = bucketed.join(sources.select("src", salts).hint("merge"), ["src", "salt"])
        else:
            joined = graph.join(_sized(sources, size), "src")
        step = joined.select(F.col("dst").alias("node")).distinct()
        # An anti join would be pushed below the step and test every edge; this one tests its result.
        known = _sized(visited.select("node", F.lit(True).alias("_seen")), seen)
        unseen = step.join(known, "node", "left").where("_seen is null")
        frontier = unseen.select("node", F.lit(level).alias("depth")).checkpoint()
        found, size = _size(frontier)
        if found == 0:
            break
        visited, seen = visited.unionByName(frontier), seen + size
    return visited


def traverse(graph: DataFrame, start: DataFrame, depth: int = 5, direction: str = "BOTH", written: bool = True) -> DataFrame:
    """Nodes within ``depth`` steps of the nodes in ``start`` (column ``node``).

    ``INPUT`` follows edges upstream, ``OUTPUT`` downstream, ``BOTH`` does each. One row
    per node and direction with its smallest depth. The edges are derived and written
    once; ``written=False`` reads ``graph`` at every level instead, for a graph that is
    stored already. A single step always does.
    """
    if direction not in ("INPUT", "OUTPUT", "BOTH"):
        raise ValueError("direction must be INPUT, OUTPUT or BOTH")
    ensure_checkpoint_dir(graph.sparkSession)
    found = []
    with ExitStack() as kept:
        own = written and depth > 1
        edges = kept.enter_context(written_edges(graph)) if own else graph
        for way in ["INPUT", "OUTPUT"] if direction == "BOTH" else [direction]:
            here, there = ("src", "dst") if way == "OUTPUT" else ("dst", "src")
            turned = edges.select(F.col(here).alias("src"), F.col(there).alias("dst"))
            found.append(_reach(turned, start, depth, kept if depth > 1 else None).withColumn("direction", F.lit(way)))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def relations(graph: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges a traversal of this depth walked over, in their own direction."""
    inner = reached.where(F.col("depth") < depth)
    forward = graph.join(inner.where("direction = 'OUTPUT'").select(F.col("node").alias("src")), "src", "left_semi")
    backward = graph.join(inner.where("direction = 'INPUT'").select(F.col("node").alias("dst")), "dst", "left_semi")
    return forward.select("src", "dst").unionByName(backward.select("src", "dst")).distinct()


def has_lineage(assets: DataFrame, graph: DataFrame) -> DataFrame:
    """Assets with two flags: some edge comes in, some edge goes out.

    The edges are read once; both ends of an edge are merged by name before the shuffle.
    """

    def end(node: str, comes_in: bool) -> Column:
        return F.struct(
            F.col(node).alias("qualified_name"), F.lit(comes_in).alias("has_in"), F.lit(not comes_in).alias("has_out")
        )

    ends = graph.select(F.inline(F.array(end("dst", True), end("src", False))))
    flags = ends.groupBy("qualified_name").agg(*[F.bool_or(c).alias(c) for c in ("has_in", "has_out")])
    return assets.join(flags, "qualified_name", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_in", "has_out")}
    )


def completeness(
    assets: DataFrame, graph: DataFrame, layers: Sequence[str] = ("bronze", "silver", "gold")
) -> DataFrame:
    """Per layer: assets, and the share with an incoming and with an outgoing edge; no sampling."""
    flagged = has_lineage(
        assets.select("qualified_name", layer_of("layer", "qualified_name").alias("layer")), graph
    )
    counted = flagged.groupBy("layer").agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if("has_in").alias("with_in"),
        F.count_if("has_out").alias("with_out"),
    )
    return on_layers(counted, layers).select(
        "layer",
        F.coalesce("assets", F.lit(0)).alias("assets"),
        F.coalesce(share_pct(F.col("with_in"), F.col("assets")), F.lit(0.0)).alias("with_incoming_pct"),
        F.coalesce(share_pct(F.col("with_out"), F.col("assets")), F.lit(0.0)).alias("with_outgoing_pct"),
    )


def on_layers(per_layer: DataFrame, layers: Sequence[str]) -> DataFrame:
    """A per-layer result with exactly the given layers, also those without a row."""
    spark = per_layer.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer"))
    return wanted.join(per_layer, "layer", "left")


# Pipelines with their slot between the layers, label and badge.
PIPELINES = {
    "staging_to_bronze": ("etl-staging-bronze", "Staging → Bronze", "ETL · Staging→Bronze"),
    "bronze_to_silver": ("etl-bronze-silver", "Bronze → Silver", "ETL · Bronze→Silver"),
    "silver_to_gold": ("etl-silver-gold", "Silver → Gold", "ETL · Silver→Gold"),
}
BADGES = {
    "staging": "Staging",
    "bronze": "Bronze",
    "silver": "Silver",
    "gold": "Gold",
    **{slot: badge for slot, _, badge in PIPELINES.values()},
    "etl": "ETL",
    "process": "ETL",
    "unknown": "Metadata",
}


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def describe_nodes(nodes: DataFrame) -> DataFrame:
    """Layer or process slot, display name and badge of lineage nodes.

    ``nodes`` has ``qualified_name, name, type_name, layer, pipeline_name, source_layer,
    target_layer``; a process takes its slot from the pipeline, else from its layers, else
    from its name.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    is_process = F.col("type_name") == PROCESS
    slots = _literal_map({p: slot for p, (slot, _, _) in PIPELINES.items()})
    labels = _literal_map({p: label for p, (_, label, _) in PIPELINES.items()})
    pipeline = F.coalesce("pipeline_name", F.lit(""))
    segment = F.split("qualified_name", r"\.").getItem(1)
    from_name = F.when(
        F.col("qualified_name").startswith("etl."), slots[F.regexp_extract(segment, "|".join(PIPELINES), 0)]
    )
    ends = F.concat(F.lit("etl-"), text("source_layer"), F.lit("-"), text("target_layer"))
    slot = F.coalesce(slots[pipeline], ends, from_name, F.lit("etl"))
    prefix = layer_from_name("qualified_name", (*LAYERS, "etl"))
    own = F.coalesce(F.when(prefix != "unknown", prefix), text("layer"), F.lit("unknown"))
    layer = F.when(is_process, slot).otherwise(own)
    process_label = F.coalesce(
        F.concat(F.lit("ETL "), labels[pipeline]), F.replace(text("name"), F.lit("_"), F.lit(" ")), F.lit("ETL process")
    )
    shown = F.when(is_process, process_label).otherwise(
        F.coalesce(text("name"), text("qualified_name"), F.lit("Dataset"))
    )
    return nodes.select(
        "qualified_name",
        F.coalesce(text("name"), text("qualified_name")).alias("name"),
        shown.alias("display_name"),
        "type_name",
        layer.alias("layer"),
        F.coalesce(_literal_map(BADGES)[layer], layer).alias("layer_label"),
        is_process.alias("is_process"),
    )


def processes_of_edge(processes: DataFrame, pipeline: str) -> DataFrame:
    """Processes of one arrow between two layers: by pipeline name or by their two layers."""
    source, target = pipeline.split("_to_")
    named = F.coalesce(F.col("pipeline_name") == pipeline, F.lit(False))
    between = (F.col("source_layer") == source) & (F.col("target_layer") == target)
    return processes.where(named | F.coalesce(between, F.lit(False)))


def nodes_by_layer(described: DataFrame) -> DataFrame:
    """How many datasets each layer of the lineage view shows."""
    return described.where(~F.col("is_process")).groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"))
