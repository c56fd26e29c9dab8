"""Connected components of a graph of any size, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.stored import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """For every node with edges the smallest of itself and its neighbours; ``edges`` has both directions."""
    return edges.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))


def connected(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Alternates two steps until nothing changes: every node links its larger neighbours to the smallest node it knows
    (large star), then its smaller neighbours and itself (small star). The number of rounds grows with the logarithm
    of the number of nodes. Minima are partly aggregated before the shuffle. Only a count and a checksum come to the
    driver; each round is written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(_smallest(both), purpose)  # a plain input of the join, so that a node with many neighbours can be split
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = stored(
            small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("_e"))
            .select("_e.a", "_e.b").where("a <> b").distinct(),
            purpose,
        )
