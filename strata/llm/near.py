"""Near-duplicate documents by a forest of sorted MinHash signatures, with every link confirmed on full shingle sets.

Documents of equal sets are one node. A signature has ``TREES`` trees of ``DEPTH`` values. Each tree sorts all nodes by its
values, so that the nodes with the longest common prefix are neighbours; neighbours with ``PREFIX`` common values or more
are one region. A crowded region is parted where its neighbours have the fewest values in common, so its windows lie as
deep as they must. In a window, nodes whose signatures agree enough are joined to a family. What parting kept asunder is
made up for: in a parted region the nodes outside its largest family are compared with all others of the region. Families
thus hold every pair of a region that may be a link. The sets of a family are compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import shingles
from strata.llm.components import connected
from strata.llm.held import release, trim
from strata.llm.stored import passing, stored

TREES, DEPTH, PREFIX = 20, 5, 3
SIMILAR = 75  # per cent of the union that the intersection of linked sets has at least
LIKELY = 0.53  # share of equal signature values from which a pair may be a link: five standard errors below 0.75
REGION = 4096  # nodes of a window, and of a block of a parted region
SALTS = 32  # tasks that share the rows of a region in a join
WEIGHT = 4_000_000  # shingles of a family that are compared together
GROUPED = 20_000  # rows that a task compares at a time, about

KEY = 1 + 4 * DEPTH  # bytes of a sort key

_SIGNATURE = shingles.multipliers(TREES * DEPTH)


def sketch(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, signature) of every document (doc_id, text).

    ``node`` names the shingle set (16 bytes); node and signature are null for the empty set.
    """

    def run(batches):
        from strata.llm.tokens import slices

        for part in slices(batches, "text"):
            counts, nodes, signatures = [], [], []
            for text in part.column("text").to_pylist():
                items = shingles.shingle_set(text)
                counts.append(len(items))
                nodes.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                signatures.append(shingles.signature(items, _SIGNATURE).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "node", "signature"],
            )
        release()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, node binary, signature binary"
    )


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node) per node and tree: a byte for the tree, then its values with the first byte highest, so that bytes sort as values."""

    def run(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            keys = np.empty((len(values), TREES, KEY), np.uint8)
            keys[:, :, 0] = np.arange(TREES)
            keys[:, :, 1:] = np.ascontiguousarray(values.astype(">u4")).view(np.uint8).reshape(len(values), TREES, KEY - 1)
            sort = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), len(values) * TREES, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            node = batch.column("node").take(pa.array(np.repeat(np.arange(len(values)), TREES)))
            yield pa.RecordBatch.from_arrays([sort, node], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key binary, node binary")


def common(keys: np.ndarray) -> np.ndarray:
    """How many values each key (a row of bytes) shares with the one before it, from the first value on; 0 for the first key and across trees."""
    shared = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        equal = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1)
        shared[1:] = equal[:, 4 : KEY : 4].sum(axis=1)
    return shared


def parted(shared: np.ndarray, most: int) -> list[int]:
    """Starts of windows of at most ``most`` rows: cut where neighbours share the fewest values, as late as that allows."""
    starts, at = [0], 0
    while len(shared) - at > most:
        half = at + most // 2 + 1
        choice = shared[half : at + most + 1]
        at = half + len(choice) - 1 - int(np.argmin(choice[::-1]))
        starts.append(at)
    return starts


def windows(batches, most: int):
    """(region, unit, node) for the sorted rows (key, node) of one task, where a region holds more than one of them.

    ``region`` names the first ``PREFIX`` values, ``unit`` the window. The first and the last region of the task may go on
    in other tasks and are always given. A window has at most ``most`` rows; of an open region at most twice as many and a batch are held.
    """
    keys, nodes, torn = np.zeros((0, KEY), np.uint8), [], True

    def given(upto, starts, shared, edges):
        ends = np.append(starts[1:], upto)
        wide = (ends - starts > 1) | edges
        cuts = [a + np.array(parted(shared[a:e], most)) for a, e in zip(starts[wide], ends[wide])]
        if not cuts:
            return None
        first = np.concatenate(cuts)
        length = np.diff(np.append(first, 0))
        lasts = np.cumsum([len(c) for c in cuts]) - 1
        length[lasts] = ends[wide] - first[lasts]
        region = _named(keys[first, : 1 + 4 * PREFIX])
        unit = _named(np.hstack([keys[first], np.frombuffer(b"".join(nodes[i] for i in first), np.uint8).reshape(len(first), -1)]))
        rows = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        columns = [pa.array(np.repeat(region, length)), pa.array(np.repeat(unit, length)), pa.array([nodes[i] for i in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["region", "unit", "node"])

    def step(last):
        nonlocal keys, nodes, torn
        shared = common(keys)
        starts = np.flatnonzero(shared < PREFIX)
        if last:
            upto = len(keys)
        elif len(keys) - starts[-1] > 2 * most:  # the front windows of an open region
            upto = starts[-1] + parted(shared[starts[-1] :], most)[-1]
        else:
            upto, starts = starts[-1], starts[:-1]
        edges = np.zeros(len(starts), bool)
        if len(starts):
            edges[0] = torn
            edges[-1] |= last or upto > starts[-1] and upto < len(keys) and shared[upto] >= PREFIX
            found = given(upto, starts, shared, edges)
            torn = bool(upto < len(keys) and shared[upto] >= PREFIX)
            keys, nodes = keys[upto:], nodes[upto:]
            return found
        return None

    for batch in batches:
        if batch.num_rows:
            keys = np.concatenate([keys, np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, KEY)])
            nodes = nodes + batch.column("node").to_pylist()
            if (found := step(False)) is not None:
                yield found
    if len(keys) and (found := step(True)) is not None:
        yield found
    release()


def _named(rows: np.ndarray) -> np.ndarray:
    """A 64-bit number for every row of bytes."""
    return np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in rows], np.int64)


def missed(members: DataFrame, families: DataFrame) -> DataFrame:
    """(unit, node): what the windows ``members`` (region, unit, node) of parted regions have not compared.

    In every region with several windows and several ``families`` (node, root) the largest family needs no comparison
    within itself. The other nodes meet one another and that family in pairs of blocks of at most about ``REGION`` nodes,
    chosen by a hash of the node. If the others fit one block, the work is in proportion to the region.
    """
    several = members.groupBy("region").agg(F.min("unit").alias("_a"), F.max("unit").alias("_b")).where("_a <> _b").select("region")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")  # a crowded region is many tasks' work in every join by region
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    wanted = members.select("region", "node", salt.alias("_salt")).join(several.withColumn("_salt", every), ["region", "_salt"])
    named = wanted.join(families, "node", "left")
    own = stored(named.select("region", "node", F.coalesce("root", "node").alias("_family")), "near-parted")
    sizes = own.groupBy("region", "_family").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy("region").agg(
        F.max(F.struct("_n", "_family")).alias("_top"), F.sum("_n").alias("_all"),
    ).where("_all > _top._n")
    counted = largest.select(
        "region", F.col("_top._family").alias("_main"),
        F.ceil(F.col("_top._n") / REGION).cast("int").alias("_mains"), F.ceil((F.col("_all") - F.col("_top._n")) / REGION).cast("int").alias("_others"),
    )
    placed = own.withColumn("_salt", salt).join(counted.withColumn("_salt", every), ["region", "_salt"]).withColumn("_in", F.col("_family") == F.col("_main"))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("node"), F.when(F.col("_in"), F.col("_mains")).otherwise(F.col("_others"))).cast("int"))
    to_others = F.expr("transform(sequence(0, _others - 1), o -> IF(_in, struct(true AS m, _block AS x, o AS y), struct(false AS m, least(_block, o) AS x, greatest(_block, o) AS y)))")
    to_main = F.expr("IF(_in, array(), transform(sequence(0, _mains - 1), k -> struct(true AS m, k AS x, _block AS y)))")
    met = placed.select("region", "node", F.explode(F.concat(to_others, to_main)).alias("_p"))
    return met.select(F.xxhash64("region", "_p.m", "_p.x", "_p.y").alias("unit"), "node")


def spread(same: int, neighbours) -> list[tuple[int, int]]:
    """Components of ``same`` items as (first item, item) pairs; ``neighbours(x, others)`` picks the linked among others.

    Breadth first: an item is compared with the items not reached yet only, so crowds of linked items cost little.
    """
    left, found = np.arange(same), []
    while len(left):
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            near = neighbours(queue.pop(), left)
            if near.any():
                reached = left[near]
                found += [(start, x) for x in reached]
                queue += list(reached)
                left = left[~near]
    return found


def _pairs(table: pa.Table, key: str, joined) -> pa.Table:
    """``joined(rows)`` for the rows of every value of ``key``, as a table of node pairs."""
    keys = table.column(key).to_numpy()
    order = np.argsort(keys, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(order) else np.zeros(0, int)
    left, right = [], []
    nodes = table.column("node").to_pylist()
    for a, b in zip(bounds, np.append(bounds[1:], len(order))):
        rows = order[a:b]
        for x, y in joined(rows):
            left.append(nodes[x])
            right.append(nodes[y])
    trim()
    return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})


def likely_pairs(table: pa.Table) -> pa.Table:
    """In every region of the table pairs that join the nodes whose signatures agree in ``LIKELY`` of their values."""
    width = TREES * DEPTH
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, width)

    def joined(rows):
        own = signatures[rows]
        found = spread(len(rows), lambda x, others: (own[others] == own[x]).sum(axis=1) >= LIKELY * width)
        return [(rows[x], rows[y]) for x, y in found]

    return _pairs(table, "unit", joined)


def linked_pairs(table: pa.Table) -> pa.Table:
    """In every unit of the table pairs that join the nodes connected by links of their full sets."""
    sets = [np.frombuffer(s, np.uint64) for s in table.column("items").to_pylist()]

    def joined(rows):
        sizes = np.array([len(sets[r]) for r in rows])
        starts = np.cumsum(sizes) - sizes
        _, items = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
        marked = np.zeros(items.max() + 1, bool)

        def neighbours(x, others):
            fits = others[(sizes[others] * 100 >= SIMILAR * sizes[x]) & (sizes[x] * 100 >= SIMILAR * sizes[others])]
            if not len(fits):
                return np.zeros(len(others), bool)
            marked[items[starts[x] : starts[x] + sizes[x]]] = True
            lengths = sizes[fits]
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) + np.repeat(starts[fits] - (ends - lengths), lengths)
            both = np.add.reduceat(marked[items[place]].astype(np.int64), ends - lengths)
            marked[items[starts[x] : starts[x] + sizes[x]]] = False
            return np.isin(others, fits[100 * both >= SIMILAR * (lengths + sizes[x] - both)])

        return [(rows[x], rows[y]) for x, y in spread(len(rows), neighbours)]

    return _pairs(table, "unit", joined)


def _units(frame: DataFrame, key: str, blocks: str, block) -> DataFrame:
    """``frame`` with ``unit``: rows of a key with several blocks go to one unit per pair of blocks that has theirs."""
    own = frame.withColumn("_block", F.pmod(block, F.col(blocks)).cast("int"))
    others = F.explode(F.expr(f"sequence(0, cast({blocks} AS int) - 1)"))
    paired = own.withColumn("_other", others)
    return paired.withColumn("unit", F.xxhash64(key, F.least("_block", "_other"), F.greatest("_block", "_other"))).drop("_block", "_other")


def near_groups(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= 75 * union of their shingle sets (:mod:`strata.llm.shingles`); empty
    sets have no links. ``component_id`` is the smallest doc_id that links reach; ``kept`` marks it. Rows without doc_id
    take no part: component null, kept. Rows of equal doc_id and different texts are different nodes with one label.
    Two sets with a Jaccard similarity of 0.75 share a region with probability 1 - 1.7e-5, more similar ones almost
    surely; all else is exact. Crowded regions are parted into windows of ``REGION`` neighbours, and what the windows do not
    join is compared in pairs of blocks of about as many nodes, so nothing is capped. Families of more than ``WEIGHT``
    shingles are divided into blocks by a hash of the node, and every pair of blocks is compared. An empty table gives none.
    The result is a stored table; signatures, regions and families are deleted once it is written.
    """
    with passing(documents.sparkSession):
        return stored(_grouped(documents), "near-result", stays=True)


def _grouped(documents: DataFrame) -> DataFrame:
    drawn = stored(sketch(documents), "near-sketches")
    known = drawn.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(
        known.groupBy("node").agg(
            F.min("doc_id").alias("label"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
        ),
        "near-nodes",
    )
    signatures = nodes.select("node", "signature")
    ordered = keyed(nodes).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    most = REGION  # a value of the job, not of the worker's module
    members = stored(ordered.mapInArrow(lambda batches: windows(batches, most), "region long, unit long, node binary"), "near-regions")

    def compared(units: DataFrame) -> DataFrame:
        tasks = max(1, -(-units.count() // GROUPED))
        held = units.select("unit", "node").join(signatures, "node").withColumn("_task", F.pmod(F.xxhash64("unit"), F.lit(tasks)))
        return held.groupBy("_task").applyInArrow(likely_pairs, "a binary, b binary").distinct()

    joined = connected(compared(members), "near-joined")
    rest = stored(missed(members, joined), "near-rest")
    families = connected(compared(rest).unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))), "near-families")

    heavy = families.join(nodes.select("node", "label", "n"), "node")
    weights = heavy.groupBy("root").agg(F.ceil(F.sum("n") / WEIGHT).cast("long").alias("_blocks"), F.sum("n").alias("_weight"))
    units = stored(_units(heavy.join(weights, "root"), "root", "_blocks", F.xxhash64("node")).select("label", "node", "unit", "n"), "near-units")
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // WEIGHT))

    def sets(batches):
        from strata.llm.tokens import slices

        for part in slices(batches, "text", most_rows=64):
            found = [(n, s.tobytes()) for n, t in zip(part.column("node").to_pylist(), part.column("text").to_pylist())
                     if hashlib.blake2b((s := shingles.shingle_set(t)).tobytes(), digest_size=16).digest() == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], names=["node", "items"])
        release()

    wanted = units.select("label", "node").distinct().hint("merge")  # the same plan at every size
    texts = documents.select(F.col("doc_id").cast("long").alias("label"), "text").join(wanted, "label").select("node", "text")
    items = texts.mapInArrow(sets, "node binary, items binary").dropDuplicates(["node"])
    confirmed = (
        units.select("node", "unit").join(items, "node").withColumn("_task", F.pmod(F.xxhash64("unit"), F.lit(tasks)))
        .groupBy("_task").applyInArrow(linked_pairs, "a binary, b binary")
    )
    groups = connected(confirmed.distinct(), "near-groups")

    rooted = nodes.select("node", "label").join(groups, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("_root").agg(F.min("label").alias("component_id"))
    named = rooted.join(smallest, "_root").select("node", "component_id")
    return drawn.select("doc_id", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )

