"""The trie of conversation prefixes: sorted shards, and a skeleton of the splitter paths between them.

A conversation is a path of turns, each a 16-byte digest of role and text; texts never move. Paths are range-partitioned
and sorted. A node that two shards share is a prefix of the path at which the later one begins, so the trie of these
splitters (the skeleton) is all that shards need to know of each other. Every shard finishes the nodes below the
skeleton in one sweep; of skeleton nodes it hands out what its own rows add, and these parts are summed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.stored import passing, stored

DIGEST = 16  # bytes of a turn in a path
SHARD = 1 << 16  # turns of a shard, about
SHARDS = 20_000  # at most; shards grow beyond SHARD only with more than SHARD * SHARDS turns
TRIE_BYTES = 32 << 20  # a larger skeleton is not broadcast: every shard is sent the splitters beside it
FAMILY = 20  # conversations that borrow the first turns of the same one
_WORDS = r"[^\x20\x09-\x0D]+"

LOCAL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = "own binary, parent binary, place long, words long, chunk string"


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family: unsigned crc32 of the decimal id, modulo 4."""
    return F.pmod(F.crc32(F.encode(conv_id.cast("string"), "UTF-8")), F.lit(4)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation: ``DIGEST`` bytes and a number of words per rebuilt turn.

    Turns are ordered by turn (null first), equal ones by their digests. A conversation is one row of 28 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * DIGEST)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORDS)).alias("words")).alias("_turn"))
    own = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns")).select("conv_id", F.transform("_turns", lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("_turns")), "trie-turns")
    heads = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("_head"), F.slice("_turns", 1, 3).alias("_first"))
    joined = own.withColumn("_of", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, F.col("_of") == F.col("_head"), "left").withColumn("_h", borrowed(F.col("conv_id")))
    first = F.coalesce(F.expr("slice(_first, 1, _h)"), F.expr("slice(_turns, 1, 0)"))
    turns = F.concat(first, F.expr("slice(_turns, _h + 1, greatest(0, size(_turns) - _h))"))
    return joined.select("conv_id", turns.alias("_turns")).select("conv_id", F.unhex(F.array_join("_turns.digest", "")).alias("path"), F.col("_turns.words").alias("words"))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with in common."""
    most = min(len(a), len(b)) // DIGEST
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """An open node of a sweep: a prefix of the path that is being read."""

    __slots__ = ("place", "words", "conv", "convs", "children", "leaves", "saved", "ends", "hash", "own")

    def __init__(self, place: int, words: int, state=None):
        self.place, self.words, self.conv, self.convs, self.children, self.leaves, self.saved = place, words, None, 0, 0, 0, 0
        self.ends, self.hash, self.own = [], state, state.digest() if state else None


def sweep(paths: list[bytes], words: list[list[int]], ids: list[int], splitters: list[bytes]) -> tuple[list[tuple], list[tuple]]:
    """The nodes of one shard, whose rows are sorted by path and id: finished ones, and parts of skeleton nodes.

    A node is part of the skeleton if it is a prefix of a splitter (``splitters`` are sorted). Finished rows are those of
    ``LOCAL`` and the digest of the parent if that is in the skeleton; parts those of ``LOCAL`` and ``PARTS``, where
    children, leaves and savings are those of finished children and their subtrees only.
    """
    finished: list[list] = []
    parts: list[tuple] = []
    above: list[tuple[int, bytes | None]] = []  # of each finished row: place of its parent, digest if in the skeleton
    convs: dict[int, int] = {}  # smallest member of finished nodes by place
    root = Node(0, 0, hashlib.blake2b(digest_size=DIGEST))
    stack, place, before = [root], 1, b""

    def close() -> None:
        node = stack.pop()
        depth, parent = len(stack), stack[-1] if stack else None
        if parent:
            parent.convs += node.convs
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        text = ",".join(map(str, node.ends))
        if node.own is not None:
            parts.append((node.conv, depth, None, node.convs, node.children, node.leaves, node.saved, None, node.own, parent.own if parent else None, node.place, node.words, text or None))
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.words
            parent.children += 1
            convs[node.place] = node.conv
            above.append((parent.place, parent.own))
            finished.append([node.conv, depth, None, node.convs, node.children, node.leaves, node.saved, hashlib.sha256(text.encode()).hexdigest()])
            parent.leaves += node.leaves
            parent.saved += node.saved

    for path, counts, conv in zip(paths, words, ids):
        common, turns = shared(path, before), len(path) // DIGEST
        while len(stack) - 1 > common:
            close()
        if turns > common:
            near = bisect_right(splitters, path)
            reach = max((shared(path, s) for s in splitters[max(0, near - 1) : near + 1]), default=0)
            for depth in range(common, turns):
                state = None
                if depth < reach:
                    state = stack[-1].hash.copy()
                    state.update(path[depth * DIGEST : (depth + 1) * DIGEST])
                stack.append(Node(place, counts[depth], state))
                place += 1
        top = stack[-1]
        top.convs += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
        before = path
    while stack:
        close()
    for row, (parent, own) in zip(finished, above):
        if own is None:
            row[2] = convs[parent]
    return [(*row, own) for row, (_, own) in zip(finished, above)], parts


_FIELDS = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_SWEPT = pa.schema([*_FIELDS, ("own", pa.binary()), ("parent", pa.binary()), ("place", pa.int64()), ("words", pa.int64()), ("chunk", pa.string()), ("shard", pa.int32())])


def _swept(table: pa.Table, splitters: list[bytes]) -> pa.Table:
    """``sweep`` of the rows of one shard as a table; finished rows have no ``own``."""
    table = table.sort_by([("path", "ascending"), ("conv_id", "ascending")])
    finished, parts = sweep(table.column("path").to_pylist(), table.column("words").to_pylist(), table.column("conv_id").to_pylist(), splitters)
    shard = table.column("shard")[0].as_py()
    rows = [(*r[:8], None, r[8], None, None, None, shard) for r in finished] + [(*r, shard) for r in parts]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _SWEPT)], schema=_SWEPT)


def _ends(batches):
    """(own, ends_sha256) of every skeleton node from its chunks of ids, in order; holds one chunk and one hash."""
    own, state = None, None
    for batch in batches:
        done = []
        for node, chunk in zip(batch.column("own").to_pylist(), batch.column("chunk").to_pylist()):
            if node != own:
                if own is not None:
                    done.append((own, state.hexdigest()))
                own, state = node, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["own", "ends_sha256"])
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["own", "ends_sha256"])


def _totals(batches):
    """Skeleton nodes in the order of their paths, with what their subtrees hold; the open path is all that is kept."""
    names = ["own", *(n for n, _ in _FIELDS[:-1])]
    types = [pa.binary(), *(t for _, t in _FIELDS[:-1])]
    stack: list[list] = []
    done: list[tuple] = []

    def close() -> None:
        own, conv, depth, parent, convs, children, leaves, saved, words = stack.pop()
        leaves += children == 0
        saved += (convs - 1) * words
        if stack:
            stack[-1][6] += leaves
            stack[-1][7] += saved
        done.append((own, conv, depth, parent, convs, children, leaves, saved))

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            while stack and stack[-1][2] >= row["depth"]:
                close()
            parent = stack[-1] if stack else None
            if parent:
                parent[5] += 1
            stack.append([row["own"], row["conv_id"], row["depth"], parent and parent[1], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"], row["words"]])
        if done:
            yield out()
    while stack:
        close()
    if done:
        yield out()


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD, shards: int = SHARDS, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text), the textless root included.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Null role or text is empty; rows without conv_id take no part; rows that are repeated are
    turns of their own; equal turns are ordered by their digests; other columns are ignored. A table without
    conversations has no nodes.

    No node, hot prefix or group of equal conversations is bound to a task: the id is part of the sort key, so shards
    have about ``shard_turns`` turns whatever repeats (a single row, that is one conversation, is the least). The
    splitters are collected and broadcast if they have at most ``trie_bytes`` bytes, and sent to their shards by a
    cogroup otherwise. One task passes the skeleton, which has at most a path per shard, holding one path. The ids
    that end at a node are hashed as one text, as asked for; ids of a hot node come as one chunk of text per shard and
    pass one task as a stream. The result is a stored table; what leads to it is deleted.
    """
    with passing(conversations.sparkSession):
        return stored(_trie(conversations, shard_turns, shards, trie_bytes), "trie-result", stays=True)


def _trie(conversations: DataFrame, shard_turns: int, most: int, trie_bytes: int) -> DataFrame:
    spark = conversations.sparkSession
    paths = stored(rebuilt(conversations), "trie-paths")
    size = paths.agg(F.sum(F.greatest(F.lit(1), F.octet_length("path") / DIGEST))).first()[0] or 0
    count = max(1, min(most, -(-int(size) // shard_turns)))
    sharded = stored(paths.repartitionByRange(count, "path", "conv_id").withColumn("shard", F.spark_partition_id()), "trie-shards")

    borders = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))  # a row per shard
    following = borders.selectExpr("shard", "first", "lag(last) OVER (ORDER BY shard) AS before", "lag(shard) OVER (ORDER BY shard) AS left").where("before IS NOT NULL")

    def cut(batches):
        for batch in batches:
            paths = [a[: shared(a, b) * DIGEST] for a, b in zip(batch.column("first").to_pylist(), batch.column("before").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("left"), pa.array(paths, pa.binary())], names=["shard", "left", "path"])

    splitters = stored(following.mapInArrow(cut, "shard int, left int, path binary"), "trie-splitters")
    small = (splitters.agg(F.sum(F.octet_length("path"))).first()[0] or 0) <= trie_bytes
    schema = f"{LOCAL}, {PARTS}, shard int"
    if small:
        trie = spark.sparkContext.broadcast(sorted({r["path"] for r in splitters.select("path").distinct().collect()}))
        swept = sharded.groupBy("shard").applyInArrow(lambda table: _swept(table, trie.value), schema)
    else:  # the splitters at both ends of a shard hold all of the skeleton that it meets
        beside = splitters.select("shard", "path").unionByName(splitters.select(F.col("left").alias("shard"), "path"))
        swept = sharded.groupBy("shard").cogroup(beside.groupBy("shard")).applyInArrow(lambda table, own: _swept(table, sorted(own.column("path").to_pylist())), schema)
    nodes = stored(swept, "trie-nodes")

    parts = nodes.where("own IS NOT NULL")
    reduced = parts.groupBy("own").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min(F.struct("shard", "place")).alias("_place"),
    )
    totals = reduced.coalesce(1).sortWithinPartitions("_place").drop("_place").mapInArrow(_totals, "own binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    skeleton = stored(totals, "trie-skeleton")
    ends = parts.where("chunk IS NOT NULL").select("own", "shard", "chunk").repartition("own").sortWithinPartitions("own", "shard").mapInArrow(_ends, "own binary, ends_sha256 string")
    columns = [n for n, _ in _FIELDS]
    ended = skeleton.join(ends, "own", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).select(*columns)

    finished = nodes.where("own IS NULL")
    names = skeleton.select(F.col("own").alias("parent"), F.col("conv_id").alias("_above"))
    hung = finished.where("parent IS NOT NULL").join(F.broadcast(names) if small else names, "parent").withColumn("parent_conv_id", F.col("_above"))
    return finished.where("parent IS NULL").select(*columns).unionByName(hung.select(*columns)).unionByName(ended)
