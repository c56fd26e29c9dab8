"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A word is a run of letters, of digits or of other marks; a feature is a word or two words in a row, hashed to one of
2**BITS places. Its value is the root of its count, and a text's values have length 1. A score is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.language import held_out
from strata.llm.names import fresh
from strata.llm.shingles import mix
from strata.llm.stored import stored

BITS = 18
SAMPLE = 8192  # labelled documents that the model is fitted on, at most
PARTS = 4  # parts of the sample that are learned side by side
EPOCHS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.02, 0.1
THRESHOLD = 0.7
CHUNK = 1 << 20  # bytes of a text that are hashed at a time

_BASE = 0x9E3779B97F4A7C55
_POWERS, _INVERSE = [np.cumprod(np.full(CHUNK + 1, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
_PAIR = np.uint64(0xD1342543DE82EF95)


def _kinds() -> np.ndarray:
    """The kind of every byte: 0 between words, 1 letter (also all bytes of code points above ASCII), 2 digit, 3 mark."""
    kinds = np.full(256, 3, np.uint8)
    kinds[128:] = 1
    for b in range(128):
        c = chr(b)
        kinds[b] = 0 if c.isspace() or b < 32 else 1 if c.isalpha() else 2 if c.isdigit() else 3
    return kinds


_KINDS = _kinds()


def words(raw: bytes) -> np.ndarray:
    """A hash of every word of at most ``CHUNK`` bytes, in order."""
    codes = np.frombuffer(raw, np.uint8)
    kind = np.zeros(len(codes) + 2, np.uint8)
    kind[1:-1] = _KINDS[codes]
    edge = np.flatnonzero(kind[1:] != kind[:-1])  # a run of one kind reaches from an edge to the next
    first, last = edge[:-1], edge[1:]
    real = kind[first + 1] > 0
    first, last = first[real], last[real]
    running = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(codes)], out=running[1:])
    return mix((running[last] - running[first]) * _INVERSE[first])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending, distinct) and values of a whole text; nothing without words.

    A long text is taken a chunk at a time, cut after its last space (or anywhere if it has none); pairs reach over cuts.
    """
    raw, at, before, counts = (text or "").encode("utf-8", "surrogatepass"), 0, None, None
    found: list[np.ndarray] = []
    while at < len(raw):
        upto = min(len(raw), at + CHUNK)
        if upto < len(raw) and (space := max(raw.rfind(b" ", at, upto), raw.rfind(b"\n", at, upto))) > at:
            upto = space + 1
        own = words(raw[at:upto])
        row = own if before is None else np.concatenate([before, own])
        both = np.concatenate([own, mix(row[:-1] * _PAIR + row[1:])]) >> np.uint64(64 - BITS)
        if upto < len(raw) or counts is not None:
            counts = np.bincount(both.astype(np.int64), minlength=1 << BITS) + (0 if counts is None else counts)
        else:
            found.append(both)
        before, at = own[-1:] if len(own) else before, upto
    if counts is not None:
        places = np.flatnonzero(counts)
        values = np.sqrt(counts[places])
    elif found:
        places, times = np.unique(found[0], return_counts=True)
        values = np.sqrt(times)
    else:
        places, values = np.zeros(0, np.int64), np.zeros(0)
    return places.astype(np.int64), values / max(1e-12, float(np.sqrt((values**2).sum())))


class Learner:
    """The state of follow-the-regularised-leader, the last place being that of the constant."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        own = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(own @ values, -35, 35))) - label) * values
        more = self.n[at] + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * own
        self.n[at] = more


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """The weight of every place and, last, of the constant.

    Learns from ``labels`` (doc_id, quality) outside the held-out fold: the ``sample`` labels with the smallest hash of
    doc_id, whatever the size of the table. Documents without label, null labels and null doc_ids take no part; a
    doc_id with both labels teaches both. The sample is dealt to ``PARTS`` tasks by hash; each passes its documents one
    by one, in the order of their hash, starting from the same state, and the states are averaged after every epoch.
    Only the states, of fixed size, come to the driver. Without labels all weights are 0.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_label")).distinct()
    chosen = known.where(F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0) & ~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # ``sample`` pairs

    def extract(batches):
        from strata.llm.tokens import slices

        for part in slices(batches, "text", most_rows=64):
            found = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("_label"), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["id", "label", "places", "values"],
            )

    rows = stored(texts.select("doc_id", "text", "_label").mapInArrow(extract, "id long, label double, places binary, values binary"), "quality-sample")
    part = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(PARTS))
    dealt = rows.withColumn("part", part).repartition(PARTS, "part").sortWithinPartitions("part", F.xxhash64("id"), "id", "label", "places")
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        parts = dealt.mapInArrow(_epoch(z.astype("f4"), n.astype("f4")), "z binary, n binary, rows long").collect()
        if total := sum(r["rows"] for r in parts):
            z = sum(np.frombuffer(r["z"], "f4").astype(float) * r["rows"] for r in parts) / total
            n = sum(np.frombuffer(r["n"], "f4").astype(float) * r["rows"] for r in parts) / total
    return Learner(z, n).weights(np.arange(size))


def _epoch(z: np.ndarray, n: np.ndarray):
    """One pass over the rows of a task from the state (``z``, ``n``); hands out the state that it ends with."""

    def run(batches):
        learner, rows = Learner(z.astype(float), n.astype(float)), 0
        for batch in batches:
            for label, places, values in zip(batch.column("label").to_pylist(), batch.column("places").to_pylist(), batch.column("values").to_pylist()):
                learner.update(np.frombuffer(places, "<i4"), np.frombuffer(values, "<f4").astype(float), label)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict({"z": [learner.z.astype("f4").tobytes()], "n": [learner.n.astype("f4").tobytes()], "rows": [rows]}, pa.schema([("z", pa.binary()), ("n", pa.binary()), ("rows", pa.int64())]))

    return run


def score(documents: DataFrame, weights: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) of every whole text.

    Null texts and texts without words have the score of the constant alone. Repeated rows are scored alike; an empty
    table gives no rows. ``carry`` names the input columns to keep (default: all); those named like a result are replaced.
    """
    results = ("held_out", "score", "predicted")
    kept = [c for c in documents.columns if (carry is None or c in carry) and c not in results]
    own_id, own_text = fresh(kept, "_id", "_text")
    inputs = documents.select(*kept, F.col("doc_id").alias(own_id), F.col("text").alias(own_text))
    constant, table = float(weights[-1]), weights[:-1].astype("f4")

    def run(batches):
        from strata.llm.tokens import slices

        for part in slices(batches, own_text):
            sums = [constant + float(table[p] @ v) for p, v in map(features, part.column(own_text).to_pylist())]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in range(len(kept))] + [part.column(own_id), pa.array(scores)], names=[*kept, own_id, "score"])

    scored = inputs.mapInArrow(run, inputs.drop(own_text).schema.add("score", "double"))
    return scored.select(*kept, held_out(F.col(own_id)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Learn from the labels and score every document."""
    return score(documents, learn(documents, labels), carry)
