"""Scans."""

from __future__ import annotations

import logging
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

log = logging.getLogger(__name__)


def read_staging(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Headered CSV with every column as text; an empty field is NULL."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line)


def read_staging_or_none(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame | None:
    """As ``read_staging``, but None when the file is missing or holds no rows.

    Emptiness takes at most one row, not a count.
    """
    try:
        df = read_staging(spark, path, multi_line)
    except AnalysisException as missing:
        log.warning("skipping %s: %s", path, missing.getCondition())
        return None
    if not df.columns or df.isEmpty():
        log.warning("skipping %s: no rows", path)
        return None
    return df


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table ``namespace.table`` of the session catalog."""
    return spark.table(name)


def table_of(path_column: str, folder: str) -> Column:
    """First name below ``folder`` in a path, without extension: a file, or the folder of a table."""
    inner = re.sub(r"^[A-Za-z0-9]+:/*", "", folder).strip("/")
    return F.regexp_extract(path_column, rf"\Q{inner}\E/+([^/]+?)(\.[^./]*)?(/.*)?$", 1).alias("table_name")


def csv_records(spark: SparkSession, folder: str, header: bool = True) -> DataFrame:
    """(file_path, n): how many records each CSV file below ``folder`` holds, line breaks within quotes included.

    A file is read in as many tasks as its size asks for. A line ends a record if an even number of quotes lies before
    its end, as a quoted field opens and closes with one and holds only doubled ones. Each byte range gives its lines,
    whether its quotes are even, and how many of its lines end a record if it begins outside a field, or inside. Only
    lines with an odd number of quotes, which open or close a field over a line break, are looked at one by one: they
    divide a range into stretches that are all outside or all inside. A running sum over the ranges of a file tells
    where each begins. As in reading, blank lines outside fields are no records; a field that is never closed ends with
    its file. The first record of a file is its header.
    """
    text = spark.read.options(pathGlobFilter="*.csv", recursiveFileLookup=True).text(folder)
    at = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block")]
    filled = text.select("value", *at).where(F.col("value").rlike(r"[^\x00-\x20]"))
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    lines = filled.select("file_path", "block", F.monotonically_increasing_id().alias("line"), odd.alias("odd"))  # consecutive within a range
    ranges = lines.groupBy("file_path", "block").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count_if("odd").alias("odds"))
    turn = F.row_number().over(Window.partitionBy("file_path", "block").orderBy("line"))
    # outside before the first odd line, inside from it to before the second, and so on
    signed = F.when(turn % 2 == 1, F.col("line")).otherwise(-F.col("line"))
    turns = lines.where("odd").select("file_path", "block", signed.alias("signed")).groupBy("file_path", "block").agg(F.sum("signed").alias("turns"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    known = ranges.join(turns, ["file_path", "block"], "left").withColumn("inside", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2 == 1)
    size = F.col("last") - F.col("first") + 1
    outside = F.coalesce("turns", F.lit(0)) - F.col("first") + F.when(F.col("odds") % 2 == 0, F.col("last") + 1).otherwise(0)
    ended = F.when(F.col("inside"), size - outside).otherwise(outside)
    records = known.groupBy("file_path").agg((F.sum(ended) + F.sum("odds") % 2).alias("n"))
    return records.select("file_path", F.greatest(F.lit(0), F.col("n") - F.lit(int(header))).cast("bigint").alias("n"))


def dataset_summary(spark: SparkSession, folder: str, file_format: str = "csv") -> DataFrame:
    """One row per table of a folder, be it one file or a folder of files: rows, bytes and megabytes.

    A file of zero bytes has no header either; Spark does not list it. One scan over all
    files of the folder; rows are counted per file, no column is decoded (CSV records by ``csv_records``).
    Sizes come from a listing that does not open the files.
    """
    find = {"pathGlobFilter": f"*.{file_format}", "recursiveFileLookup": True}
    listing = spark.read.format("binaryFile").options(**find).load(folder)
    sizes = listing.groupBy(table_of("path", folder)).agg(F.sum("length").alias("size_bytes"))
    if file_format == "csv":
        per_file = csv_records(spark, folder)
    else:
        scan = spark.read.format(file_format).schema("_unused string").options(**find)
        per_file = scan.load(folder).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    counted = per_file.groupBy(table_of("file_path", folder)).agg(F.sum("n").alias("row_count"))
    return sizes.join(counted, "table_name", "left").select(
        "table_name",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "size_bytes",
        F.round(F.col("size_bytes") / 1024**2, 2).alias("size_mb"),
    )


def summary_totals(summary: DataFrame) -> DataFrame:
    """Totals over a dataset summary."""
    return summary.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.sum("row_count").alias("total_rows"),
        F.round(F.sum("size_bytes") / 1024**2, 2).alias("total_size_mb"),
    )
