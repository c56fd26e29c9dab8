"""Nearest neighbours by inner product with randomly rotated one-bit codes and exact reranking.

A vector is normalised and rotated by a fixed random orthogonal matrix; its code is the sign of every coordinate, packed
to bits. With the scalar ``fit`` (inner product of the rotated vector and its code) the inner product with any other
unit vector is estimated without bias from the code, within a bound that holds with high probability. Only vectors whose
upper bound reaches the best exact values found so far are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.stored import stored

NEAREST = 20
BOUND = 2.5  # standard errors of the estimate that count as possible
BLOCK = 16_384  # vectors of a block, at most about
BLOCKS = 64  # blocks at least, for parallel work
QUERY_BLOCK = 8_192
TOGETHER = 256  # queries that are compared with a block at once
FLOOR_SAMPLE = 4_096  # vectors that give every query a first lower bound


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix that depends on dimension and seed only."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: Column, d: int) -> Column:
    """Whether a vector has ``d`` components, all finite, and one that is not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == d) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Vectors of a list column as rows in double precision."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose rounding does not depend on a row's place, so equal vectors tie."""
    return (rows * query).sum(axis=1)


def encode(vectors: DataFrame, id_column: str, column: str, d: int) -> DataFrame:
    """(id, vector, code, norm, fit) of every usable vector."""
    def run(batches):
        turn, root = rotation(d), np.sqrt(d)
        for batch in batches:
            rows = matrix(batch.column("vector"), d)
            # by the largest component first, so that squares neither overflow nor vanish
            largest = np.abs(rows).max(axis=1, initial=0) if len(rows) else np.zeros(0)
            scaled = rows / largest[:, None]
            length = np.sqrt((scaled**2).sum(axis=1))
            turned = (scaled / length[:, None]) @ turn.T
            bits = np.packbits(turned > 0, axis=1)
            fit = np.abs(turned).sum(axis=1) / root
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length * largest), pa.array(fit)],
                names=["id", "vector", "code", "norm", "fit"],
            )

    chosen = vectors.where(usable(F.col(column), d)).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    return chosen.mapInArrow(run, "id long, vector array<double>, code binary, norm double, fit double")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, asks: Column, k: int = NEAREST, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For every usable vector that ``asks`` selects its ``k`` nearest others: query_id, rank, vec_id, score.

    Score is the inner product in double precision. Vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part, nor do rows without id. Repeated ids: every row is a candidate, but not
    of a query of the same id; the query of a repeated id is its smallest vector. Fewer candidates than ``k`` give them
    all; an empty table gives no rows.

    Every vector is indexed. Vectors and queries are dealt to blocks by hash, so equal vectors spread; each pair of a
    vector block and a query block is one small task: estimates for all its pairs from the codes, exact values for
    those that may be among the best. A task keeps at most ``k`` rows per query, and none below the ``k``-th best
    among ``FLOOR_SAMPLE`` vectors, which is a lower bound for the final result; a window merges the blocks.
    """
    common = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 1
    index = stored(encode(vectors.where(F.col(id_column).isNotNull()), id_column, column, d), "vector-codes")
    queries = stored(
        vectors.where(asks & usable(F.col(column), d)).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(F.col(column).cast("array<double>")).alias("vector")),
        "vector-queries",
    )
    rows, asked = index.count(), queries.count()
    blocks, query_blocks = max(BLOCKS, -(-rows // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    sample = index.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(FLOOR_SAMPLE).toArrow()
    sample_ids, sample_rows = sample.column("id").to_numpy(), matrix(sample.column("vector"), d)

    def floors(batches):
        """With every query the ``k``-th best value among the sample, or minus infinity."""
        for batch in batches:
            values = matrix(batch.column("vector"), d) @ sample_rows.T
            values[batch.column("id").to_numpy()[:, None] == sample_ids] = -np.inf
            floor = np.sort(values, axis=1)[:, -k] if len(sample_ids) >= k else np.full(len(values), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(floor - 1e-9 * np.abs(floor))], names=["id", "vector", "floor"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            turn, root = rotation(d), np.sqrt(d)
            ids, exact = left.column("id").to_numpy(), matrix(left.column("vector"), d)
            norm, fit = left.column("norm").to_numpy(), left.column("fit").to_numpy()
            packed = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            signs = (np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1).T
            scale = norm / fit / root
            error = BOUND * norm * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(1, d - 1))
            query_ids, query_rows, low = right.column("id").to_numpy(), matrix(right.column("vector"), d), right.column("floor").to_numpy()
            for at in range(0, len(query_ids), TOGETHER):
                some = query_rows[at : at + TOGETHER]
                lengths = np.sqrt((some**2).sum(axis=1))
                estimate = ((some @ turn.T).astype(np.float32) @ signs) * scale
                reach = estimate + lengths[:, None] * error
                for q in range(len(some)):
                    least = low[at + q]
                    likely = np.flatnonzero((reach[q] >= least) & (ids != query_ids[at + q]))
                    if len(likely) > 4 * k:  # the likeliest first: their exact values raise the floor
                        first = likely[np.argpartition(-estimate[q, likely], 2 * k)[: 2 * k]]
                        least = max(least, np.sort(products(exact[first], some[q]))[-k])
                        likely = likely[reach[q, likely] >= least]
                    scores = products(exact[likely], some[q])
                    keep = scores >= low[at + q]
                    likely, scores = likely[keep], scores[keep]
                    top = best(ids[likely], scores, k)
                    found.append((np.full(len(top), query_ids[at + q]), ids[likely][top], scores[top]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    # both sides meet by (vector block, query block); a block goes to every block of the other side
    left = index.withColumn("_b", F.pmod(F.xxhash64("id", "norm", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    left = left.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.mapInArrow(floors, "id long, vector array<double>, floor double")
    right = right.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.groupBy("_b", "_q").cogroup(right.groupBy("_b", "_q")).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
