"""Packing documents into sequences of bounded length by multiway differencing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.karmarkar import deal
from strata.llm.names import aliases
from strata.llm.stored import stored

CAPACITY = 2048
PIECE = 512  # longest piece of a document's rest: more pieces per window, more equal windows
BATCH = 384  # pieces that are dealt together
END = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """The pieces of ``n`` ids: full sequences first, then the rest in the fewest pieces of at most ``piece`` and equal size."""
    whole = n // capacity * capacity
    found = [(a, capacity) for a in range(0, whole, capacity)]
    rest = n - whole
    parts = -(-rest // piece)
    at = whole
    for k in range(parts):
        size = rest // parts + (k < rest % parts)
        found.append((at, size))
        at += size
    return found


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """Every piece of every document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens; null text: only the end id."""

    def run(batches):
        from strata.llm.tokens import encoder, slices

        encode = encoder(vocabulary)
        end = np.array([END], "<u4").tobytes()
        for part in slices(batches, "text", most_rows=1024):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.encode(part.column("text"))):
                ids += end
                n = len(ids) // 4
                rows += [(doc_id, a, size, zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a, size in cuts(n, capacity, piece)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def windows_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A window for every length (each at most ``capacity``), none above ``capacity``: one window more until all fit."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = deal(lengths, k)
        if np.bincount(window, lengths, k).max(initial=0) <= capacity:
            return window
        k += 1 + k // 400


def pack(pieces: DataFrame, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """``pieces`` (with column length, 1 to ``capacity``) with ``sequence_id`` (gapless from 0) and ``offset`` within the sequence.

    Pieces of full length are sequences of their own. The others are dealt to batches of about ``batch`` pieces by a
    hash of a running number, so equal documents spread; each batch is one small task, solved by differencing, with
    as many windows as its sum needs and more if a window would overflow. Sequences are numbered by the totals of the
    batches. Lengths of other columns do not matter; extra columns are kept. An empty table gives no rows.
    """
    own = aliases(c for c in pieces.columns if c not in ("sequence_id", "offset"))
    kept, length = list(own.values()), own["length"]
    numbered = stored(pieces.select(*[F.col(c).alias(a) for c, a in own.items()], F.monotonically_increasing_id().alias("_row")), "pack-pieces")
    count = numbered.where(F.col(length) < capacity).count()
    batches = max(1, -(-count // batch))
    dealt = numbered.withColumn("_batch", F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("long"))

    def solve(table: pa.Table) -> pa.Table:
        lengths = table.column(length).to_numpy().astype(np.int64)
        full = lengths >= capacity
        window = np.zeros(len(lengths), np.int64)
        window[~full] = windows_of(lengths[~full], capacity)
        window[full] = window.max(initial=-1) * (~full).any() + (~full).any() + np.arange(full.sum())
        order = np.lexsort((table.column("_row").to_numpy(), window))
        ordered = lengths[order]
        starts = np.cumsum(ordered) - ordered
        new = np.append(True, np.diff(window[order]) != 0)
        offset = starts - np.maximum.accumulate(np.where(new, starts, 0))
        return table.take(order).append_column("_window", pa.array(window[order])).append_column("offset", pa.array(offset))

    schema = dealt.select(*kept, "_row", "_batch").schema.add("_window", "long").add("offset", "long")
    solved = stored(dealt.select(*kept, "_row", "_batch").groupBy("_batch").applyInArrow(solve, schema), "pack-windows")
    before = Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)  # one row per batch
    bases = solved.groupBy("_batch").agg((F.max("_window") + 1).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return solved.join(bases, "_batch").select(*[F.col(a).alias(c) for c, a in own.items()], (F.col("_base") + F.col("_window")).cast("long").alias("sequence_id"), "offset")


def pack_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """All documents cut into pieces and packed."""
    return pack(pieces_of(documents, vocabulary))
