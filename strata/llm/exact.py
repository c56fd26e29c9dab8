"""Exact deduplication with an extendible-hash index whose directory and entries are shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.names import aliases
from strata.llm.stored import stored
from strata.llm.urls import LOWER, UPPER


DEEPEST = 30  # bits of a directory at most
BROADCAST = 20  # bits of a directory that every task may hold: a million cells of 12 bytes


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def directory(hashes: DataFrame, capacity: int, start: int, rows: int) -> tuple[DataFrame, int]:
    """The directory of an extendible-hash index over the 64-bit column ``hash``: (cell, depth, pages) per used cell, and its depth.

    A cell is the upper bits of a hash, as many as the directory is deep; a bucket covers all cells that share its
    ``depth`` upper bits and holds at most ``capacity`` rows. The index starts with 2**``start`` buckets and doubles its
    directory until a cell holds a sixteenth of the capacity on average, so the directory grows with the ``rows`` while
    the buckets keep their size. Only overfull buckets are split; counting starts twelve
    doublings above the full depth, where a bucket would hold 256 times its capacity on average. A bucket that is overfull at full depth holds copies or
    colliding hashes; it gets ``pages`` overflow pages of the capacity.
    """
    bits = min(DEEPEST, max(start + 4, (16 * rows // capacity).bit_length()))
    lowest = max(start, bits - 12)
    cells = hashes.groupBy(F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("cell")).agg(F.count("*").alias("rows"))
    levels = cells.select("*", F.explode(F.sequence(F.lit(lowest), F.lit(bits))).alias("depth")).withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
    full = F.sum("rows").over(Window.partitionBy("depth", "bucket"))
    fitting = levels.withColumn("full", full).where((F.col("full") <= capacity) | (F.col("depth") == bits))
    found = fitting.groupBy("cell").agg(
        F.min("depth").alias("depth"), F.max(F.when(F.col("depth") == bits, F.ceil(F.col("rows") / capacity)).otherwise(1)).cast("int").alias("pages")
    )
    return found, bits


def deduplicate(
    rows: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, capacity: int = 32768, start: int = 10
) -> DataFrame:
    """``rows`` with ``keep_id`` (largest key of the rows with the same normalised text), ``group_size``, ``kept``, ``text_sha256``.

    1. The hash of every normalised text is written to the shared folder, and from it the directory, which is broadcast
       while it is at most ``BROADCAST`` bits deep and joined by cell beyond.
    2. Every row goes to the owner task of its bucket, a range of hashes; rows of an overfull bucket that cannot be
       split are dealt to its overflow pages. Within a page rows are chained by hash and compared by their bytes: a
       window over (hash, text) gives the size and largest key of each chain. The chained rows are written to the
       shared folder.
    3. Chains of a bucket with several pages are merged: one row per page and text, grouped again by hash and bytes.

    ``carry`` names the input columns to keep (default: all, the key always; those named like a result are replaced).
    Null texts count as empty. Exactly one row of a group is kept: of repeated largest keys any one (their texts are
    equal). A group without any key has a null keep_id and keeps one row. An empty table gives no rows.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    carried = [c for c in rows.columns if (carry is None or c in carry or c == key) and c not in results]
    own = aliases(carried)
    inside, key = list(own.values()), own[key]
    hashed = rows.select(*[F.col(c).alias(a) for c, a in own.items()], normalised(F.col(text)).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    entries = stored(hashed.select(F.col("_hash").alias("hash")), "dedup-entries")
    found, bits = directory(entries, capacity, start, entries.count())
    small = bits <= BROADCAST
    cells = stored(found.coalesce(1) if small else found, "dedup-directory")
    chain = Window.partitionBy("_bucket", "_page", "_hash", "_text")
    owned = (
        hashed.withColumn("_cell", F.shiftrightunsigned("_hash", 64 - bits).cast("int"))
        .join(F.broadcast(cells) if small else cells, F.col("_cell") == F.col("cell"))
        .withColumn("_bucket", F.expr(f"shiftleft(shiftright(_cell, {bits} - depth), {bits} - depth)"))
        .withColumn("_page", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("pages")).cast("int"))
        .withColumn("text_sha256", F.sha2(F.encode("_text", "UTF-8"), 256))
        .repartition("_bucket", "_page")
        .withColumn("_first", F.row_number().over(chain.orderBy(F.col(key).desc_nulls_last())) == 1)
        .withColumn("_n", F.count("*").over(chain))
        .withColumn("_largest", F.max(key).over(chain))
        .withColumn("_text", F.when((F.col("pages") > 1) & F.col("_first"), F.col("_text")))
    )
    chained = stored(owned.drop("_cell", "cell", "depth", "_bucket"), "dedup-chains")
    alone = chained.where("pages = 1").select(
        *inside, F.col("_largest").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_first").alias("kept"), "text_sha256"
    )
    merged = (
        chained.where("pages > 1 AND _first")
        .groupBy("_hash", "_text")
        .agg(
            F.first("text_sha256").alias("text_sha256"), F.sum("_n").alias("group_size"),
            F.max(F.struct("_largest", "_page")).alias("_winner"),
        )
        .select("text_sha256", "group_size", "_winner")
    )
    paged = chained.where("pages > 1").join(merged, "text_sha256").select(
        *inside, F.col("_winner._largest").alias("keep_id"), "group_size",
        (F.col("_first") & (F.col("_page") == F.col("_winner._page"))).alias("kept"), "text_sha256",
    )
    return alone.unionByName(paged).select(*[F.col(a).alias(c) for c, a in own.items()], "keep_id", "group_size", "kept", "text_sha256")
