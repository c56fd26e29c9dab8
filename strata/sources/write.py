"""Sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def create_namespace(spark: SparkSession, namespace: str) -> None:
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")


def _files(spark: SparkSession, path: str):
    """Hadoop's path class and the file system of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _described(spark: SparkSession, what: str) -> dict[str, str]:
    """The properties that ``DESCRIBE EXTENDED`` shows of a table or namespace."""
    return {r[0]: r[1] for r in spark.sql(f"DESCRIBE {what}").collect()}


def _layout(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def settle_table(spark: SparkSession, name: str) -> None:
    """Give a table its old rows back if a replacement by another layout was cut off between its two renames."""
    if spark.catalog.tableExists(name):
        return
    namespace, _, table = name.rpartition(".")
    inside = f" IN {namespace}" if namespace else ""
    for row in spark.sql(f"SHOW TABLES{inside} LIKE '{table}__old_*'").collect():
        spark.sql(f"ALTER TABLE {namespace + '.' if namespace else ''}{row.tableName} RENAME TO {name}")
        return


def settle_files(spark: SparkSession, path: str) -> None:
    """Give a folder its old rows back if a replacement was cut off between its two renames."""
    parent, _, name = path.rstrip("/").rpartition("/")
    at, files = _files(spark, path)
    if not files.exists(at(path)):
        for status in files.globStatus(at(f"{parent}/_{name}-old-*")) or []:
            files.rename(status.getPath(), at(path))
            return


def replace_table(df: DataFrame, name: str, table_format: str = "parquet", partition_by: tuple = ()) -> DataFrame:
    """Replace a table by the rows of ``df`` (which may read the table) and return the written table.

    A table format with a catalog of its own (for example Iceberg) is replaced in one commit. In the session catalog rows
    of the layout that the table has (columns, types, format; managed, without partitions) go to a new folder beside the table's, and
    one change of its location is the only switch: a crash before leaves the old rows, a crash after it the new ones.
    Rows of another layout are written to a new table, which takes over the name in two renames; if these are cut off in
    between, :func:`settle_table` brings the old rows back, as does the next replacement. A failed write leaves the
    table as it was.
    """
    spark = df.sparkSession
    if table_format in ("iceberg", "delta"):
        df.writeTo(name).using(table_format).createOrReplace()
        return spark.table(name)
    settle_table(spark, name)
    replaced = spark.catalog.tableExists(name)
    known = _described(spark, f"TABLE EXTENDED {name}") if replaced else {}
    managed = known.get("Type") == "MANAGED"
    if managed and not partition_by and "# Partition Information" not in known and _layout(spark.table(name)) == _layout(df):
        if known["Provider"].lower() == table_format:
            return _switch(df, name, table_format, known["Location"])
    fresh, old = (f"{name}__{kind}_{uuid.uuid4().hex}" for kind in ("new", "old"))
    writer = df.write.format(table_format)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(fresh)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    if replaced:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    if managed and "-version-" in known["Location"].rpartition("/")[2]:
        _clear_place(spark, name)
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    if replaced:
        spark.sql(f"DROP TABLE {old}")
    return spark.table(name)


def _clear_place(spark: SparkSession, name: str) -> None:
    """Delete a version that a switch has left in the folder of this name when it was cut off before its deletion."""
    namespace, _, table = name.rpartition(".")
    home = _described(spark, f"NAMESPACE EXTENDED {namespace or spark.catalog.currentDatabase()}")["Location"]
    at, files = _files(spark, home)
    files.delete(at(f"{home.rstrip('/')}/{table}"), True)


def _switch(df: DataFrame, name: str, table_format: str, location: str) -> DataFrame:
    """Write a version of a table and point the table to it, then delete the version before."""
    spark = df.sparkSession
    parent = location.rstrip("/").rpartition("/")[0]
    version = f"{parent}/_{name.rpartition('.')[2]}-version-{uuid.uuid4().hex}"
    at, files = _files(spark, location)
    try:
        df.write.format(table_format).save(version)
    except Exception:
        files.delete(at(version), True)
        raise
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
    spark.catalog.refreshTable(name)
    files.delete(at(location), True)
    return spark.table(name)


def replace_files(df: DataFrame, path: str) -> DataFrame:
    """Replace Parquet files under a path by the rows of ``df`` (which may read the path) and return the written rows.

    The rows are written to a folder beside the path, which takes its place once it is complete; a failed write leaves
    the old files as they were. The place is taken in two renames; if these are cut off in between, :func:`settle_files`
    brings the old rows back, as does the next replacement. Renaming costs nothing on a file system and a copy on an
    object store, where a table format with commits is the better choice.
    """
    spark = df.sparkSession
    settle_files(spark, path)
    parent, _, name = path.rstrip("/").rpartition("/")
    fresh, old = (f"{parent}/_{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    at, files = _files(spark, path)
    try:
        df.write.parquet(fresh)
    except Exception:
        files.delete(at(fresh), True)
        raise
    replaced = files.exists(at(path))
    if replaced and not files.rename(at(path), at(old)):
        raise OSError(f"cannot replace {path}; the new rows are in {fresh}")
    if not files.rename(at(fresh), at(path)):
        raise OSError(f"cannot move {fresh} to {path}" + (f"; the old rows are in {old}" if replaced else ""))
    if replaced:
        files.delete(at(old), True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Rows as headered CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)
