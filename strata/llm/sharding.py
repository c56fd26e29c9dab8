"""Sharding by jump consistent hashing: the key and the shard count decide, and a further shard only takes rows into itself."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.offsets import with_before

# The generator of the published jump consistent hash.
_MULTIPLIER = 2862933555777941757


def jump(key: Column | str, shards: int) -> Column:
    """Struct of ``shard`` (0 to ``shards`` - 1) and ``grown`` (the shard among one more) of a long key; a null key counts as 0.

    The walk jumps over growing shard numbers with a 64-bit linear congruential generator seeded by the key (in decimals,
    as a product of 64-bit numbers overflows a long). Every step moves to a larger number, so ``shards`` steps suffice;
    after the walk ``jump`` is the first number that a key moves to once more shards exist.
    """
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("long"), F.lit(0))
    unsigned = F.pmod(key.cast("decimal(20,0)"), F.lit(Decimal(1 << 64)))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"), unsigned.cast("decimal(20,0)").alias("seed"))

    def step(state: Column, _: Column) -> Column:
        seed = F.pmod(state["seed"] * F.lit(Decimal(_MULTIPLIER)) + F.lit(1), F.lit(Decimal(1 << 64))).cast("decimal(20,0)")
        return F.when(state["jump"] >= shards, state).otherwise(F.struct(state["jump"].alias("at"), F.lit(-1).cast("long").alias("jump"), seed.alias("seed")))

    def land(state: Column) -> Column:
        # (at + 1) * 2**31 / (upper 31 bits of the seed + 1), as published
        upper = (state["seed"] - F.pmod(state["seed"], F.lit(Decimal(1 << 33)))).cast("double") / float(1 << 33)  # exact
        far = F.floor((state["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / (upper + 1.0))).cast("long")
        return F.when(state["jump"] >= 0, state).otherwise(F.struct(state["at"].alias("at"), far.alias("jump"), state["seed"].alias("seed")))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda s, i: land(step(s, i)))
    return F.transform(
        F.array(walk), lambda s: F.struct(s["at"].cast("int").alias("shard"), F.when(s["jump"] == shards, F.lit(shards)).otherwise(s["at"]).cast("int").alias("grown"))
    )[0]


def shard(rows: DataFrame, key: str, shards: int, tie: list[Column] | None = None, buckets: int = 256) -> DataFrame:
    """``rows`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``, the row's place in its shard, gapless from 0.

    Rows of equal keys (repeated or null) share a shard. Slots follow a hash of key and ``tie`` dealt to ``buckets``
    buckets, then the key, then ``tie``; a hot key spreads over tasks as far as ``tie`` tells its rows apart. An empty
    table gives no rows. Input columns named shard, grown_shard or slot are replaced.
    """
    tie = tie or []
    placed = rows.drop("shard", "grown_shard", "slot").withColumn("_jump", jump(key, shards))
    placed = placed.withColumn("shard", F.col("_jump.shard")).withColumn("grown_shard", F.col("_jump.grown")).drop("_jump")
    return with_before(placed, "shard", F.xxhash64(F.col(key), *tie), [F.col(key), *tie], F.lit(1), buckets, "slot")


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Digest of :func:`shard` for ``documents``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and checksum 0; a null doc_id is sharded as key 0.
    """
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    sized = documents.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard(sized, "doc_id", shards, [F.col("text_crc32"), F.col("size")]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
