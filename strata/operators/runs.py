"""Run history: latest runs, total run time and the experiment summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strata.operators.refine import dedup

# Kinds of reports, the beginnings of their names.
DATASET_SUMMARY, REGISTRATION = "dataset_summary", "registration"


def latest_runs(runs: DataFrame, by: str = "pipeline", time: str = "ended_at", tiebreak: tuple = ()) -> DataFrame:
    """The newest run of every pipeline."""
    return dedup(runs, [by], [F.col(time).desc(), *tiebreak])


def newest(runs: DataFrame, n: int, by: str = "pipeline", time: str = "ended_at", tiebreak: tuple = ()) -> DataFrame:
    """The newest ``n`` runs of every pipeline; tasks send at most ``n`` rows per pipeline."""
    order = Window.partitionBy(by).orderBy(F.col(time).desc(), *tiebreak)
    return runs.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= n).drop("_row")


def total_runtime(latest: DataFrame, duration: str = "duration_sec") -> DataFrame:
    """Summed duration over the latest runs, three digits; NULL when nothing ran."""
    total = F.sum(F.col(duration).cast("decimal(18,3)")).cast("double")
    return latest.agg(
        F.count(F.lit(1)).alias("pipelines"), F.nullif(F.round(total, 3), F.lit(0.0)).alias("runtime_total_sec")
    )


def experiment_summary(
    experiment_id: str,
    as_of: str,
    runs: DataFrame,
    quality: DataFrame,
    coverage: DataFrame,
    umt: DataFrame,
    reports: DataFrame | None = None,
    newest_of_kind: int = 3,
) -> DataFrame:
    """One row: latest run per pipeline, total run time, quality and coverage by layer, catalog size, newest reports.

    ``reports`` (kind, report, file_time, document) gives the newest dataset summaries and registration snapshots, as
    (report, document), the newest last. The collected lists hold one entry per pipeline or layer, or
    ``newest_of_kind`` reports.
    """
    latest = latest_runs(runs)
    entries = latest.agg(
        F.array_sort(F.collect_list(F.struct("pipeline", "duration_sec", "rows_written"))).alias("pipelines")
    )
    listed = lambda df: df.select(
        F.array_sort(F.collect_list(F.struct(*df.columns))).alias("x")
    ).scalar()
    def newest_reports(kind: str):
        if reports is None:
            return F.array().cast("array<struct<report: string, document: string>>")
        own = newest(reports.where(F.col("kind") == kind), newest_of_kind, "kind", "file_time", (F.col("report").desc(),))
        ordered = own.select(F.array_sort(F.collect_list(F.struct("file_time", "report", "document"))).alias("x"))
        return ordered.select(F.transform("x", lambda r: F.struct(r["report"].alias("report"), r["document"].alias("document")))).scalar()

    return entries.select(
        F.lit(experiment_id).alias("experiment_id"),
        F.lit(as_of).alias("generated_at"),
        "pipelines",
        total_runtime(latest).select("runtime_total_sec").scalar().alias("pipeline_runtime_total_sec"),
        listed(quality).alias("metadata_quality"),
        listed(coverage).alias("metadata_coverage"),
        umt.select(F.count(F.lit(1))).scalar().alias("umt_rows"),
        newest_reports(DATASET_SUMMARY).alias("dataset_summaries"),
        newest_reports(REGISTRATION).alias("registration_snapshots"),
    )
