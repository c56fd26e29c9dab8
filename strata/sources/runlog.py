"""Run records: one JSON document per run, appended to a folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from strata.sources.read import table_of

TABLE_RESULT = StructType(
    [
        StructField("table_name", StringType()),
        StructField("row_count", LongType()),
        StructField("status", StringType()),
        StructField("written", BooleanType()),
        StructField("error", StringType()),
    ]
)
RUN_SCHEMA = StructType(
    [
        StructField("pipeline", StringType()),
        StructField("started_at", StringType()),
        StructField("ended_at", StringType()),
        StructField("duration_sec", DoubleType()),
        StructField("tables_total", LongType()),
        StructField("tables_written", LongType()),
        StructField("rows_written", LongType()),
        StructField("tables", ArrayType(TABLE_RESULT)),
    ]
)


def run_record(
    spark: SparkSession,
    pipeline: str,
    results: Mapping[str, Mapping],
    started_at: datetime,
    ended_at: datetime,
) -> DataFrame:
    """One row on a run: duration, how many tables were written and their rows."""
    written = [r for r in results.values() if r.get("written")]
    row = (
        pipeline,
        started_at.isoformat(),
        ended_at.isoformat(),
        round((ended_at - started_at).total_seconds(), 3),
        len(results),
        len(written),
        sum(int(r.get("row_count") or 0) for r in written),
        [tuple(r.get(f.name, name if f.name == "table_name" else None) for f in TABLE_RESULT) for name, r in results.items()],
    )
    return spark.createDataFrame([row], RUN_SCHEMA)


def append_run(record: DataFrame, folder: str) -> None:
    record.coalesce(1).write.mode("append").json(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All run records with the time their file was written."""
    return spark.read.schema(RUN_SCHEMA).json(folder).withColumn(
        "file_time", F.col("_metadata.file_modification_time")
    )


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """A report of one row as a JSON document below ``folder``, under its name."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/{name}")


def read_reports(spark: SparkSession, folder: str, kinds: Sequence[str]) -> DataFrame:
    """(kind, report, file_time, document) of the JSON reports of any shape below ``folder``.

    A report is a file, or a folder that holds one; its kind is the one of ``kinds`` that its name begins with, before an
    underscore. Others are left out.
    """
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    named = text.select(
        table_of("_metadata.file_path", folder).alias("report"), F.col("_metadata.file_modification_time").alias("file_time"), F.col("value").alias("document")
    )
    kind = F.coalesce(*[F.when(F.startswith("report", F.lit(f"{k}_")), F.lit(k)) for k in kinds])
    return named.where("document <> ''").withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "report", "file_time", "document")
