"""Token ids as Arrow stream files of fixed-size lists: every sequence and its mask is found by its number, without a copy.

A file holds the ids of a run of documents as one stream, cut into sequences of equal length. A record batch holds the
same number of sequences, so sequence ``i`` is row ``i % rows`` of batch ``i // rows`` and its ids are one slice of a
mapped buffer. The mask tells ids from the padding of the file's last sequence. A second stream file beside it lists
the documents: doc_id, start (ids of the file before it), n_tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.stored import stored
from strata.sources.scratch import new_folder

LENGTH = 2048  # ids of a sequence
ROWS = 64  # sequences of a record batch
END = 1  # the id after each document


def _filesystem(folder: str):
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def token_schema(length: int, narrow: bool) -> pa.Schema:
    """ids (unsigned, of 16 bits if the vocabulary allows) and mask, both as lists of ``length``."""
    return pa.schema([("ids", pa.list_(pa.uint16() if narrow else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenWriter:
    """Appends documents to one pair of files; holds at most one record batch and one document in memory."""

    def __init__(self, sink, index_sink, length: int = LENGTH, rows: int = ROWS, narrow: bool = True):
        self.length, self.rows, self.dtype = length, rows, np.uint16 if narrow else np.uint32
        self.schema = token_schema(length, narrow)
        self.tokens = pa.ipc.new_stream(sink, self.schema)
        self.index = pa.ipc.new_stream(index_sink, DOCUMENTS)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.entries: list[tuple] = []

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.tokens.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema
        ))

    def _flush(self, last: bool = False) -> None:
        size = self.length * self.rows
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        for at in range(0, len(ids) - size + 1, size):
            self._batch(ids[at : at + size], size)
        ids = ids[len(ids) // size * size :]
        if last and len(ids):
            full = -(-len(ids) // self.length) * self.length
            self._batch(np.concatenate([ids, np.zeros(full - len(ids), self.dtype)]), len(ids))
            ids = ids[:0]
        self.waiting, self.held = [ids], len(ids)

    def _list(self) -> None:
        columns = zip(*self.entries) if self.entries else ([], [], [])
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=DOCUMENTS))
        self.entries = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id, self.total, len(ids)))
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.rows:
            self._flush()
        if len(self.entries) >= 8192:
            self._list()

    def close(self) -> None:
        self._flush(last=True)
        self._list()
        self.tokens.close()
        self.index.close()


class TokenFile:
    """Random access to one token file. A local file is mapped: only what is asked for is read."""

    def __init__(self, filesystem, path: str):
        source = pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path)
        reader = pa.ipc.open_stream(source)
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)
        self.rows = self.batches[0].num_rows if self.batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence ``i``."""
        batch, row = self.batches[i // self.rows], i % self.rows
        at = row * self.length
        return batch.column("ids").flatten().to_numpy()[at : at + self.length], batch.column("mask").flatten().slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, over as many sequences as they span (a view if they lie in one batch)."""
        size = self.rows * self.length
        parts = []
        for b in range(start // size, (start + n - 1) // size + 1 if n else start // size):
            flat = self.batches[b].column("ids").flatten().to_numpy()
            parts.append(flat[max(0, start - b * size) : start + n - b * size])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_tokens(documents: DataFrame, vocabulary: str, folder: str, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Encode all ``documents`` (doc_id, text) and write them in ascending doc_id order (null first); returns the manifest.

    One pair of files per range of doc_ids; the manifest (part, path, documents, tokens) is a stored table that names
    the files of the attempts that succeeded, so files of lost or repeated attempts do no harm. Rows of equal doc_id
    follow a hash of their text. Null and empty texts have only the end id. An empty table gives an empty manifest.
    """

    def write(batches):
        from strata.llm.tokens import encoder, slices

        encode, writer, count = encoder(vocabulary), None, 0
        narrow = encode.tokenizer.get_vocab_size() <= 1 << 16
        filesystem, base = _filesystem(folder)
        task = TaskContext.get()
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        end = np.array([END], "<u4")
        for part in slices(batches, "text", most_rows=1024):
            if writer is None:
                filesystem.create_dir(base, recursive=True)
                sinks = filesystem.open_output_stream(f"{path}.arrow"), filesystem.open_output_stream(f"{path}.docs.arrow")
                writer = TokenWriter(*sinks, length, rows, narrow)
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.encode(part.column("text"))):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
            count += part.num_rows
        if writer is not None:
            writer.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "documents": [count], "tokens": [writer.total]},
                                             schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return stored(ordered.select("doc_id", "text").mapInArrow(write, "part int, path string, documents long, tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, in no order."""

    def read(batches):
        filesystem, _ = _filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                tokens = TokenFile(filesystem, f"{path}.arrow")
                with filesystem.open_input_stream(f"{path}.docs.arrow") as source:
                    for entries in pa.ipc.open_stream(source):
                        starts, sizes = entries.column("start").to_pylist(), entries.column("n_tokens").to_pylist()
                        sums = [zlib.crc32(tokens.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts, sizes)]
                        yield pa.RecordBatch.from_arrays(
                            [entries.column("doc_id"), pa.array([base + a for a in starts], pa.int64()), entries.column("n_tokens"), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))
    spread = placed.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "part").select("path", "base")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents to a new shared folder and read them back."""
    folder = new_folder(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, vocabulary, folder), folder)
