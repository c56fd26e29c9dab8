"""Running a layer: build each table, apply the gate, write, profile, record.

Tables of a layer do not depend on each other, so a few are built at a time and share the
cluster. Only small facts reach the driver: one gate row and one row count per table. Profiles are taken from the written tables and stored as a table of
their own (layer ``metadata``), so nothing is computed twice.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.operators import profile
from strata.operators.catalog import with_pii_columns
from strata.operators.kpi import gold_profile, kpi_summary
from strata.operators.refine import union_all
from strata.sources.read import read_staging_or_none, read_table
from strata.sources.runlog import append_run, run_record
from strata.sources.write import create_namespace, replace_files, replace_table, settle_files, settle_table

log = logging.getLogger(__name__)

Tables = Mapping[str, DataFrame]
LOAD = "load_batch"  # partition of tables that grow by batches
# What building a table gives: its result (None if there was nothing to load) and its profile.
Built = tuple[dict | None, DataFrame | None]


@dataclass(frozen=True)
class Lake:
    """Where tables live: namespaces of the session catalog, or Parquet folders under ``root``."""

    spark: SparkSession
    root: str | None = None
    table_format: str = "parquet"

    def read(self, layer: str, name: str, batches: bool = False) -> DataFrame:
        """A table; of one that grows by batches the rows of all, with the batch of each if ``batches``."""
        if self.root is None:
            settle_table(self.spark, f"{layer}.{name}")
            table = read_table(self.spark, f"{layer}.{name}")
        else:
            path = f"{self.root}/{layer}/{name}"
            settle_files(self.spark, path)
            table = self.spark.read.option("mergeSchema", batches).parquet(path)
        return table if batches else table.drop(LOAD)

    def put_batch(self, df: DataFrame, layer: str, name: str, batch: str) -> DataFrame:
        """Make ``df`` the rows of one batch of a table and return them; other batches stay, the same one is replaced."""
        if not batch.isalnum():
            raise ValueError("a batch is named by letters and digits")
        if self.root is not None:
            path = f"{self.root}/{layer}/{name}/{LOAD}={batch}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        create_namespace(self.spark, layer)
        table = f"{layer}.{name}"
        if self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{c}`" for c in self.read(layer, name).columns)
            self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({LOAD} = '{batch}') SELECT {columns} FROM {{rows}}", rows=df)
        else:
            df.withColumn(LOAD, F.lit(batch)).write.format(self.table_format).partitionBy(LOAD).saveAsTable(table)
        return read_table(self.spark, table).where(F.col(LOAD) == batch).drop(LOAD)

    def replace(self, df: DataFrame, layer: str, name: str) -> DataFrame:
        if self.root is not None:
            return replace_files(df, f"{self.root}/{layer}/{name}")
        create_namespace(self.spark, layer)
        return replace_table(df, f"{layer}.{name}", self.table_format)


@dataclass(frozen=True)
class Refined:
    """A refined table. ``build`` gets the source tables by name.

    ``gated`` names the sources whose quality decides; with ``gate='report'`` the table is
    written even when they are rejected.
    """

    name: str
    sources: Sequence[str]
    gated: Sequence[str]
    steps: Sequence[str]
    build: Callable[[Tables, str], DataFrame]
    gate: str = "skip"


@dataclass(frozen=True)
class Curated:
    """A gold table: dimension or fact. ``value`` and ``unit`` describe the KPI of a fact.

    ``value``, ``target`` and ``attainment`` are the names of these columns in the fact.
    """

    name: str
    table_type: str
    sources: Sequence[str]
    build: Callable[[Tables], DataFrame]
    value: str | None = None
    unit: str = "%"
    target: str = "target_iku"
    attainment: str = "capaian_iku"


@dataclass
class LayerRun:
    """Outcome of a run: one result per table, and the stored profiles of the written tables."""

    pipeline: str
    started_at: datetime
    ended_at: datetime | None = None
    results: dict[str, dict] = field(default_factory=dict)
    profiles: DataFrame | None = None
    pending: list[DataFrame] = field(default_factory=list)

    def finish(self, lake: Lake, run_folder: str | None) -> LayerRun:
        if self.pending:
            self.profiles = self._merge_profiles(lake)
            self.pending.clear()
        self.ended_at = datetime.now(timezone.utc)
        if run_folder is not None:
            record = run_record(lake.spark, self.pipeline, self.results, self.started_at, self.ended_at)
            append_run(record, run_folder)
        return self

    def _merge_profiles(self, lake: Lake) -> DataFrame:
        """This run's profiles take the place of the stored ones of the same tables; those of other tables stay."""
        name = f"{self.pipeline}_profiles"
        made = union_all(self.pending)
        try:
            before = lake.read("metadata", name)
        except AnalysisException:  # the first run
            return lake.replace(made, "metadata", name)
        tables = [row["table_name"] for profile_rows in self.pending for row in profile_rows.select("table_name").collect()]
        others = before.where(~F.col("table_name").isin(tables))
        return lake.replace(made.unionByName(others, allowMissingColumns=True), "metadata", name)

    def build_all(self, items: Mapping[str, Callable[[], Built]], workers: int) -> None:
        """Build tables that do not depend on each other, ``workers`` at a time; an error fails one table only."""

        def attempt(name: str) -> Built:
            try:
                result, made = items[name]()
                if made is not None:  # one row per table, taken here so that its errors stay here
                    made = made.sparkSession.createDataFrame(made.collect(), made.schema)
                return result, made
            except Exception as error:  # whatever fails, fails one table only
                log.error("%s failed: %s", name, error)
                return {"status": "ERROR", "row_count": 0, "written": False, "error": str(error)}, None

        with ThreadPoolExecutor(max_workers=workers) as pool:
            for name, (result, table_profile) in zip(items, pool.map(attempt, items)):
                if result is not None:
                    self.results[name] = result
                if table_profile is not None:
                    self.pending.append(table_profile)


def _start(pipeline: str) -> LayerRun:
    return LayerRun(pipeline, datetime.now(timezone.utc))


def _written(table: DataFrame, status: str) -> dict:
    return {"row_count": table.count(), "status": status, "written": True}


def run_bronze(
    lake: Lake,
    landing: str,
    pii: Mapping[str, Sequence[str]],
    run_folder: str | None = None,
    multi_line: bool = False,
    profile_plan: str = "batched",
    workers: int = 4,
) -> LayerRun:
    """Load every raw file into a table of the same name; missing and empty files are skipped.

    ``profile_plan`` is the plan of ``profile_columns``; ``once`` suits many small tables.
    """

    def load(name: str, columns: Sequence[str]) -> Built:
        raw = read_staging_or_none(lake.spark, f"{landing}/{name}.csv", multi_line)
        if raw is None:
            return None, None
        table = lake.replace(raw, "bronze", name)
        columns_profile = profile.profile_columns(table, name, plan=profile_plan)
        folded = profile.table_profile(columns_profile).drop("output_completeness")
        return _written(table, "LOADED"), with_pii_columns(folded, {name: columns})

    run = _start("staging_to_bronze")
    run.build_all({name: partial(load, name, columns) for name, columns in pii.items()}, workers)
    return run.finish(lake, run_folder)


def append_bronze(
    lake: Lake,
    landing: str,
    pii: Mapping[str, Sequence[str]],
    batch: str,
    run_folder: str | None = None,
    multi_line: bool = False,
    workers: int = 4,
) -> LayerRun:
    """Load the raw files of one batch as further rows of the tables of the same name; missing and empty files are skipped.

    Only the new rows are scanned for the profile: they are sketched by column, the sketches are kept by batch (layer
    ``metadata``), and the table's profile is the union of all of them, with exact counts and estimated distinct values.
    A batch that is loaded again takes its own place, so a run that failed can be repeated. ``batch`` is a text of
    letters and digits. Tables that ``run_bronze`` has written are not grown: load their rows as the first batch.
    """

    def load(name: str, columns: Sequence[str]) -> Built:
        raw = read_staging_or_none(lake.spark, f"{landing}/{name}.csv", multi_line)
        if raw is None:
            return None, None
        rows = lake.put_batch(raw, "bronze", name, batch)
        lake.put_batch(profile.column_sketches(rows, name), "metadata", f"{name}_sketches", batch)
        sketches = lake.read("metadata", f"{name}_sketches", batches=True).withColumnRenamed(LOAD, "part")
        folded = profile.table_profile(profile.profile_of_sketches(sketches)).drop("output_completeness")
        return _written(rows, "APPENDED"), with_pii_columns(folded, {name: columns})

    run = _start("staging_to_bronze")
    run.build_all({name: partial(load, name, columns) for name, columns in pii.items()}, workers)
    return run.finish(lake, run_folder)


def _stored_gates(lake: Lake) -> dict[str, dict]:
    """The gate of every bronze table by the profile that its load has stored: one small row per table."""
    try:
        profiles = lake.read("metadata", "staging_to_bronze_profiles")
    except AnalysisException:  # nothing has been loaded by this library
        return {}
    return {row["table_name"]: row.asDict() for row in profile.gate_of_profiles(profiles).collect()}


def _gate(tables: Tables, gated: Sequence[str], stored: Mapping[str, dict]) -> dict:
    """The decision about the gated sources: from their stored profiles, by a scan of those that have none."""
    spark = next(iter(tables.values())).sparkSession
    gates = [stored[name] if name in stored else profile.quality_gate(tables[name], name).first().asDict() for name in gated]
    if len(gates) == 1:
        return gates[0]
    schema = "table_name string, row_count bigint, column_count bigint, completeness double, quality_score double, status string"
    rows = [spark.createDataFrame([tuple(gate[c] for c in GATE_COLUMNS)], schema) for gate in gates]
    return profile.combine_gates(rows).first().asDict()


GATE_COLUMNS = ("table_name", "row_count", "column_count", "completeness", "quality_score", "status")


def run_silver(
    lake: Lake,
    recipes: Sequence[Refined],
    as_of: str,
    run_folder: str | None = None,
    profile_plan: str = "batched",
    workers: int = 4,
    scan_gate: bool = False,
) -> LayerRun:
    """Build refined tables from bronze ones; a rejected table is not written.

    The gate follows from the profiles that loading the sources has stored, so it scans nothing; ``scan_gate`` takes it
    from the rows instead, for bronze tables that something else has changed.
    """
    stored = {} if scan_gate else _stored_gates(lake)

    def refine(recipe: Refined) -> Built:
        tables = {name: lake.read("bronze", name) for name in recipe.sources}
        gate = _gate(tables, recipe.gated, stored)
        if gate["status"] == "REJECT" and recipe.gate == "skip":
            log.warning("%s rejected, score %s", recipe.name, gate["quality_score"])
            return {"row_count": 0, "status": "REJECT", "written": False}, None
        table = lake.replace(recipe.build(tables, as_of), "silver", recipe.name)
        made = profile.profile_with_provenance(
            table, recipe.name, gate["quality_score"], gate["status"], recipe.steps, recipe.sources, profile_plan
        )
        return _written(table, gate["status"]), made.withColumn("written", F.lit(True))

    run = _start("bronze_to_silver")
    run.build_all({r.name: partial(refine, r) for r in recipes}, workers)
    return run.finish(lake, run_folder)


def _kpi_row(table: DataFrame, spec: Curated) -> DataFrame | None:
    if spec.value is None:
        return None
    named = table.withColumnsRenamed({spec.target: "target", spec.attainment: "attainment"})
    return kpi_summary(named, spec.name, spec.value, spec.unit)


def run_gold(
    lake: Lake,
    specs: Sequence[Curated],
    scorecard: Callable[[Tables], DataFrame] | None = None,
    scorecard_name: str = "fact_scorecard",
    run_folder: str | None = None,
    workers: int = 4,
) -> LayerRun:
    """Build dimensions and facts, each on its own, then the scorecard over the written facts.

    A source ``raw_*`` is read from bronze, any other from silver.
    """

    def source(name: str) -> DataFrame:
        return lake.read("bronze" if name.startswith("raw_") else "silver", name)

    def curate(spec: Curated, tables: Tables | None = None) -> Built:
        if tables is None:
            tables = {name: source(name) for name in spec.sources if name != "generated"}
        table = lake.replace(spec.build(tables), "gold", spec.name)
        made = gold_profile(table, spec.name, spec.table_type, spec.sources, _kpi_row(table, spec))
        return _written(table, "WRITTEN"), made.withColumn("written", F.lit(True))

    run = _start("silver_to_gold")
    run.build_all({s.name: partial(curate, s) for s in specs}, workers)
    if scorecard is not None:
        facts = {
            s.name: lake.read("gold", s.name)
            for s in specs
            if s.table_type == "fact" and run.results[s.name]["written"]
        }
        if facts:
            summary = Curated(scorecard_name, "fact", ["all_iku_facts"], scorecard)
            run.build_all({scorecard_name: partial(curate, summary, facts)}, 1)
    return run.finish(lake, run_folder)
