"""Running totals within groups that no single task has to see whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_before(rows: DataFrame, group: str, spread: Column, order: list[Column], amount: Column, buckets: int, name: str) -> DataFrame:
    """``rows`` with column ``name``: the sum of ``amount`` over the rows of the same group that come earlier.

    The order within a group is (bucket, ``order``), where the bucket is ``spread`` modulo ``buckets``. Each bucket of a
    group is summed in a task of its own; only one total per bucket is summed along the group. ``rows`` is evaluated
    twice, so it should be a scan, a stored table or cheap; the totals prune its columns. ``group`` must not be null.
    """
    dealt = rows.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    along = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy(group, "_bucket")
        .agg(F.sum(amount).cast("long").alias("_sum"))
        .select(group, "_bucket", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(totals, [group, "_bucket"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_base", "_inside")
    )
