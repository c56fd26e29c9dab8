"""Mixing sources to target weights: fixed-length blocks, per-source index permutations, a join by block index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.offsets import with_before
from strata.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
# Fixed values of the permutation: multipliers (primes) and the shares at which a round splits the indices.
MULTIPLIERS = ((104395301, 86028121), (122949823, 49979687), (67867967, 15485863), (32452843, 141650939))
SPLITS = ((1, 2), (1, 3), (2, 5), (3, 7))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Sources ranked by code point (null last) with their ``target`` of words; ``totals`` has one row per source and its source_size.

    The weights repeat along the rank and share the sum of all sizes. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above. This is a water level: ordered by size per
    weight, the sources before the first that stays below its limit are full and the others share the rest. The table
    has one row per source, so its running sums are taken in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("rank", rank).withColumn("weight", F.array(*map(F.lit, weights))[F.col("rank") % len(weights)])
    limit = (F.col("source_size") * most).cast("long")
    ranked = ranked.withColumn("limit", limit).withColumn("_ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("_ratio", "rank")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - before) / rest
    levels = ranked.withColumn("_level", level).withColumn("_open", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("_open"), F.col("limit").cast("double")))
    return levels.select("source", "rank", "source_size", target.alias("target"))


def permuted(rows: DataFrame, index: str, size: str, rank: str, epoch: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of ``index`` in a pseudorandom permutation of 0 to ``size`` - 1 chosen by source and epoch.

    Four rounds; each multiplies the index modulo the size, then splits the range and multiplies within either part.
    A prime that does not divide the modulus makes every step a bijection, so no table of places is stored. Sizes up
    to 2**35. Each step is a column of its own, since the next one uses it several times.
    """

    def turned(x: Column, modulus: Column, primes: tuple[int, int], shift: Column) -> Column:
        prime = F.when(modulus % primes[0] == 0, F.lit(primes[1])).otherwise(F.lit(primes[0]))
        return (x * prime + shift) % modulus

    x, m = F.col(name), F.col(size)
    rows = rows.withColumn(name, F.col(index))
    for r, (primes, (up, down)) in enumerate(zip(MULTIPLIERS, SPLITS)):
        shift = (F.col(rank) + 1) * 7368787 + (F.col(epoch) + 1) * 15487469 + (r + 1) * 179424673
        cut = F.greatest(F.lit(1), F.floor(m * up / down))
        rows = rows.withColumn(name, turned(x, m, primes, shift)).withColumn("_cut", cut)
        low = turned(x, F.col("_cut"), primes[::-1], shift)
        high = F.col("_cut") + turned(x - F.col("_cut"), F.greatest(F.lit(1), m - F.col("_cut")), primes[::-1], shift)
        rows = rows.withColumn(name, F.when(x < F.col("_cut"), low).otherwise(high))
    return rows.drop("_cut")


def shard_counts(drawn: DataFrame, shards: int, chunk: int) -> DataFrame:
    """How many draws of every (source, epoch) each output shard gets, and the place of its first one.

    ``drawn`` has one row per (rank, epoch) with ``_draws``. Every draw picks a shard by hash, all shards alike, so the
    counts of a source are one multinomial draw; the picks are counted where they are made, and only the counts are
    shuffled. The shards then take consecutive places of the source, in the order of their numbers.
    """
    chunks = drawn.select("*", F.explode(F.expr(f"sequence(0L, (_draws - 1) div {chunk})")).alias("_chunk")).repartition("rank", "epoch", "_chunk")
    picks = chunks.select("*", F.explode(F.expr(f"sequence(_chunk * {chunk}, least(_draws, (_chunk + 1) * {chunk}) - 1)")).alias("_draw"))
    shard = F.pmod(F.xxhash64("rank", "epoch", "_draw"), F.lit(shards)).cast("int").alias("shard")
    counts = picks.groupBy("rank", "epoch", "source_size", "blocks", "_left", shard).agg(F.count("*").alias("count"))
    earlier = Window.partitionBy("rank", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("count").over(earlier), F.lit(0)))


def slots(plan: DataFrame, length: int, shards: int, chunk: int = 4096) -> DataFrame:
    """The draws of a mix: (rank, epoch, shard, slot, place, block, words), one row per block taken.

    A source's target is drawn in whole epochs, each taking every block once, and a last one that stops when the target
    is reached; its last block is cut there (so a source misses its target by less than a block). Every output shard
    has a drawn number of blocks of each source and epoch (:func:`shard_counts`); its slots, counted from 0, stand at
    consecutive places, which the source's permutation maps to blocks. Slots are made from chunks, so a large source
    spreads over tasks.
    """
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST)
    epochs = plan.where("source_size > 0").withColumn("_words", words).withColumn("blocks", F.ceil(F.col("source_size") / length).cast("long")).select(
        "rank", "source_size", "blocks", "_words", F.explode(F.expr("sequence(0L, _words div source_size)")).alias("epoch")
    )
    drawn = epochs.withColumn("_left", F.least(F.col("source_size"), F.expr("_words - epoch * source_size"))).where("_left > 0")
    drawn = drawn.withColumn("_draws", F.ceil(F.col("_left") / length).cast("long"))
    counts = shard_counts(drawn, shards, chunk)
    chunks = counts.select("*", F.explode(F.expr(f"sequence(0L, (count - 1) div {chunk})")).alias("_chunk")).repartition("rank", "epoch", "shard", "_chunk")
    each = chunks.select("*", F.explode(F.expr(f"sequence(_chunk * {chunk}, least(count, (_chunk + 1) * {chunk}) - 1)")).alias("slot"))
    mapped = permuted(each.withColumn("place", F.col("start") + F.col("slot")), "place", "blocks", "rank", "epoch", "block")
    return mapped.select(
        "rank", "epoch", "shard", "slot", "place", "block",
        F.when(F.col("_left") == F.col("source_size"), F.lit(length).cast("long")).otherwise(F.least(F.lit(length).cast("long"), F.expr(f"_left - place * {length}"))).alias("words"),
    )


def mix(documents: DataFrame, length: int = BLOCK, shards: int = 64, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = 256, carry: tuple[str, ...] = ()):
    """The mix of ``documents`` (doc_id, text, source): three stored or lazy tables (sizes, plan, takes).

    ``sizes``: one row per document: doc_id, source, size (words; null text: 0), rank, source_size, target, before (its
    first word among the words of its source) and the columns named by ``carry``. ``plan``: one row per source. ``takes``: one row per document and draw
    that touches it: rank, before, epoch, shard, slot, first and last (words of the document, last excluded).

    The documents of a source are laid end to end, in an order that doc_id, size and text decide, and cut into blocks of
    ``length`` words; the source's last block is shorter. Draws meet documents by (source, block). A document is taken
    at most ``most`` times, as a source's epochs are. Null sources form a source of their own; without any words every
    target is 0. Rows of equal doc_id are separate documents. An empty table gives three empty tables.
    """
    counted = documents.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_mark"))
    counted = stored(counted, "mix-sizes")
    plan = stored(targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).coalesce(1), "mix-plan")
    known = counted.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    spread = F.coalesce(F.col("doc_id"), F.col("size"))
    placed = with_before(known, "rank", spread, [F.col("doc_id"), F.col("size"), F.col("_mark")], F.col("size"), buckets, "before")
    sizes = stored(placed.drop("_mark"), "mix-places")
    pieces = sizes.where("size > 0").select(
        "rank", "before", "size", F.explode(F.expr(f"sequence(before div {length}, (before + size - 1) div {length})")).alias("block")
    )
    draws = stored(slots(plan, length, shards), "mix-draws")  # so that nothing is pushed down into the rounds
    joined = pieces.join(draws, ["rank", "block"])
    first = F.greatest(F.lit(0), F.expr(f"block * {length} - before"))
    last = F.least(F.col("size"), F.expr(f"block * {length} + words - before"))
    takes = joined.select("rank", "before", "epoch", "shard", "slot", first.alias("first"), last.alias("last")).where("last > first")
    return sizes, plan, takes


def mix_documents(documents: DataFrame) -> DataFrame:
    """Digest of :func:`mix`: doc_id, size, source_size, target and ``taken``, the words that the mix takes, repeats counted."""
    sizes, _, takes = mix(documents)
    taken = takes.groupBy("rank", "before").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    words = sizes.where("size > 0").join(taken, ["rank", "before"], "left").unionByName(
        sizes.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    )
    return words.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(documents: DataFrame) -> DataFrame:
    """The mix as documents: the columns of ``documents``, one row per document and epoch that takes any of its words.

    A document taken whole keeps its text; one taken in part keeps its taken words, joined by spaces, in order. n_chars
    follows the new text. Documents of which nothing is taken go.
    """
    rows = stored(documents.withColumn("_row", F.monotonically_increasing_id()), "mix-texts")
    sizes, _, takes = mix(rows.select("doc_id", "source", "text", "_row"), carry=("_row",))
    taken = F.sum(F.col("last") - F.col("first")).alias("_taken")
    spans = takes.groupBy("rank", "before", "epoch").agg(taken, F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"))
    placed = sizes.where("size > 0").select("rank", "before", "_row", F.col("size").alias("_size")).join(spans, ["rank", "before"])
    found = rows.join(placed.select("_row", "_size", "_taken", "_spans"), "_row")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = lambda ws: F.transform("_spans", lambda p: F.slice(ws, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")))
    # the words as a variable of a lambda, so that a text is split once and not for every span
    cut = F.transform(F.array(words), lambda ws: F.array_join(F.flatten(parts(ws)), " "))[0]
    text = F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(cut)
    kept = [F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col("_new").alias(c) if c == "text" else F.col(c) for c in documents.columns]
    return found.withColumn("_new", text).select(*kept)
