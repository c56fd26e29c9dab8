"""Language identification by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

A language is a distribution over pieces. The probability of a word is the sum over all its segmentations into pieces
of the product of their probabilities (forward algorithm); a text is the product of its words. Learning is expectation
maximisation: forward and backward sums give the expected count of every piece in the words of a sample.
"""

from __future__ import annotations

import math
import re
import string
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.held import Memory, held, trim
from strata.llm.names import fresh
SAMPLE = 1000  # labelled documents per language that the model is fitted on, at most
LANGUAGES = 200  # languages that are learned and scored together; more are taken in several groups
ROUNDS = 3
STRETCH = 24  # characters of a word that is summed together with others of its length and remembered; longer ones are summed one by one
UNKNOWN = 1e-8  # probability of a character outside the vocabulary, the same for every language
REMEMBERED = 64 << 20  # bytes of scored tokens that a worker remembers, about
ENTRY = 240  # bytes of a remembered token beside its characters and scores
_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))  # vowel signs and the like
_WORDS = re.compile(rf"[^\W\d_]+(?:[{re.escape(_MARKS)}]+[^\W\d_]*)*")

_MARKED = string.punctuation  # around a word; neither letters nor marks of letters


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 4 (null: false)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """The runs of letters and their marks of a whole text in lower case; empty without any letter."""
    runs = _WORDS.findall(text.lower()) if text else []
    return runs if any(any(map(str.isalpha, r)) for r in runs) else []


def _lettered(piece: str) -> bool:
    return piece.isalpha() or bool(piece) and all(c.isalpha() or unicodedata.category(c) in ("Mn", "Mc") for c in piece)


def pieces_of(path: str) -> dict[str, int]:
    """Lower-case pieces of letters and marks of a public sentencepiece vocabulary, numbered from 2; a leading mark means a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = sorted({n for n in names if _lettered(n.strip("▁")) and n == n.lower() and "▁" not in n[1:]})
    return {n: i + 2 for i, n in enumerate(plain)}


class Pieces:
    """Finds the numbers of many stretches of words at once, by a hash that follows from running sums over a word."""

    _BASE = 0x9E3779B97F4A7C55

    def __init__(self, pieces: dict[str, int]):
        self.numbers = pieces
        self.longest = max(map(len, pieces), default=1)
        self._powers_up_to(max(STRETCH + 2, self.longest))
        names = list(pieces)
        hashes = np.zeros(len(names), np.uint64)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            hashes[at] = self.sums([names[k] for k in at], int(n))[:, -1]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([pieces[n] for n in names], np.int32)[order]
        assert (np.diff(self.hashes) > 0).all()

    def _powers_up_to(self, n: int) -> None:
        self.powers = np.cumprod(np.full(n, self._BASE, np.uint64)).reshape(1, -1)
        self.inverse = np.cumprod(np.full(n, pow(self._BASE, -1, 1 << 64), np.uint64))

    def sums(self, words: list[str], n: int) -> np.ndarray:
        """Running sums of words of ``n`` characters, from 0 to ``n`` characters."""
        if n > self.powers.shape[1]:
            self._powers_up_to(n)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)
        found = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * (codes + np.uint64(0x51ED27)) * self.powers[:, :n], axis=1, out=found[:, 1:])
        return found

    def find(self, sums: np.ndarray, i: int, j: int) -> np.ndarray:
        """The number of every word's stretch (i, j), 0 if it is no piece."""
        if not len(self.hashes):
            return np.zeros(len(sums), np.int32)
        wanted = (sums[:, j] - sums[:, i]) * (self.inverse[i - 1] if i else np.uint64(1))
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, self.ids[at], 0)


class Segmenter:
    """Forward and backward sums of many words at once; column k of ``probability`` is language k."""

    def __init__(self, pieces: dict[str, int], probability: np.ndarray):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.known = Pieces(pieces)
        self.probability = probability  # row 0: no piece, row 1: unknown character

    def lattice(self, words: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
        """For every stretch (i, j) of words of ``n`` characters (the start mark included) the numbers of its pieces."""
        sums, found = self.known.sums(words, n), {}
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                ids = self.known.find(sums, i, j)
                if j == i + 1:
                    ids[ids == 0] = 1
                if ids.any():
                    found[i, j] = ids
        return found

    def forward(self, lattice, count: int, n: int) -> np.ndarray:
        sums = np.zeros((n + 1, count, self.probability.shape[1]))
        sums[0] = 1
        for (i, j), ids in lattice.items():  # j ascends
            sums[j] += sums[i] * self.probability[ids]
        return sums

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of every word in every language."""
        out = np.zeros((len(words), self.probability.shape[1]))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > STRETCH):
            out[k] = self.long_score("▁" + words[k])
        for length in np.unique(lengths[lengths <= STRETCH]):
            at = np.flatnonzero(lengths == length)
            marked = ["▁" + words[k] for k in at]
            out[at] = np.log(self.forward(self.lattice(marked, length + 1), len(at), length + 1)[-1])
        return out

    def ends(self, word: str, j: int) -> list[tuple[int, int]]:
        """Starts and numbers of the pieces of a marked word that end at ``j``."""
        get = self.pieces.get
        found = [(i, get(word[i:j], 0)) for i in range(max(0, j - self.longest), j)]
        return [(i, p or 1) for i, p in found if p or i == j - 1]

    def long_score(self, word: str) -> np.ndarray:
        """Log probability of one marked word of any length: the last sums are carried along, scaled before they vanish."""
        languages = self.probability.shape[1]
        reach = max(1, self.longest) + 1
        sums = np.zeros((reach, languages))  # sums[j % reach] belongs to the first j characters
        sums[0], scale = 1, np.zeros(languages)
        for j in range(1, len(word) + 1):
            ends = self.ends(word, j)
            now = (sums[[i % reach for i, _ in ends]] * self.probability[[p for _, p in ends]]).sum(0)
            sums[j % reach] = now
            if now.min() < 1e-100:
                sums /= now
                scale += np.log(now)
        return np.log(sums[len(word) % reach]) + scale

    def long_expected(self, word: str, count: float, total: np.ndarray) -> None:
        """Adds the expected count of every piece in one marked word of any length to ``total``, by logarithms."""
        known, n = self.probability[:, 0], len(word)
        arcs = [[(i, p, math.log(known[p])) for i, p in self.ends(word, j)] for j in range(1, n + 1)]
        forward = [0.0] + [-math.inf] * n
        for j, own in enumerate(arcs, 1):
            parts = [forward[i] + w for i, _, w in own]
            top = max(parts)
            forward[j] = top + math.log(sum(math.exp(x - top) for x in parts))
        weight = [0.0] * n + [float(count)]  # expected passes through a place
        for j in range(n, 0, -1):
            for i, p, w in arcs[j - 1]:
                share = weight[j] * math.exp(forward[i] + w - forward[j])
                weight[i] += share
                total[p] += share

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected count of every piece in the words, one language (the first column)."""
        total = np.zeros(len(self.probability))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > STRETCH):
            self.long_expected("▁" + words[k], counts[k], total)
        for length in np.unique(lengths[lengths <= STRETCH]):
            at = np.flatnonzero(lengths == length)
            n = int(length) + 1
            lattice = self.lattice(["▁" + words[k] for k in at], n)
            forward = self.forward(lattice, len(at), n)[..., 0]
            backward = np.zeros_like(forward)
            backward[n] = counts[at] / forward[n]
            for (i, j), ids in sorted(lattice.items(), key=lambda x: -x[0][0]):
                weight = self.probability[ids, 0] * backward[j]
                backward[i] += weight
                total += np.bincount(ids, forward[i] * weight, len(total))
        return total


def _fit(words: list[str], counts: np.ndarray, pieces: dict[str, int], rounds: int) -> np.ndarray:
    """Piece probabilities of one language, smoothed so that no piece has probability 0."""
    size = len(pieces) + 2
    probability = np.full((size, 1), 1.0 / size)
    for _ in range(rounds):
        probability[0], probability[1] = 0, UNKNOWN
        seen = Segmenter(pieces, probability).expected(words, counts)
        seen[:2] = 0
        probability = ((seen + 0.01) / (seen.sum() + 0.01 * size))[:, None]
    probability[0], probability[1] = 0, UNKNOWN
    return probability[:, 0]


def learn(documents: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> list[tuple[list[str], np.ndarray]]:
    """Groups of ``LANGUAGES`` languages at most in code point order, with the probability of every piece in each.

    Learns from text and non-null lang of the documents outside the held-out fold: of every language the ``sample``
    documents with the smallest hash of doc_id. Words are counted by Spark and each language is fitted in a task of its
    own; only the probabilities, bounded by vocabulary and languages, come to the driver, a group at a time. Without
    such documents there are no groups.
    """
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = sorted(map(tuple, labelled.groupBy("lang").count().collect()))
    groups = (_learned(labelled, dict(counts[k : k + LANGUAGES]), vocabulary, sample, rounds) for k in range(0, len(counts), LANGUAGES))
    return [(names, probability) for names, probability in groups if names]


def _learned(labelled: DataFrame, counts: dict[str, int], vocabulary: str, sample: int, rounds: int) -> tuple[list[str], np.ndarray]:
    """Those languages of ``counts`` (documents by language) that have words, and the probability of every piece in each."""
    names = list(counts)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # about twice the sample passes by hash, so that no language's rows meet in one task
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 2.0 * sample / n))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_003)) < share * 1_000_003
    chosen = labelled.where(F.col("lang").isin(names) & drawn).select("lang", "doc_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    texts = labelled.join(F.broadcast(chosen.select("lang", "doc_id").distinct()), ["lang", "doc_id"], "left_semi").select("lang", "text")  # sample * languages rows

    def split(batches):
        from strata.llm.tokens import slices

        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                words = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    def fit(table: pa.Table) -> pa.Table:
        pieces = pieces_of(vocabulary)
        found = _fit(table.column("word").to_pylist(), table.column("n").to_numpy().astype(float), pieces, rounds)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "probability": [found.tolist()]}, pa.schema([("lang", pa.string()), ("probability", pa.list_(pa.float64()))]))

    totals = texts.mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    rows = totals.groupBy("lang").applyInArrow(fit, "lang string, probability array<double>").collect()
    fitted = sorted((r["lang"], r["probability"]) for r in rows)
    return [name for name, _ in fitted], np.array([p for _, p in fitted]).T if fitted else np.zeros((0, 0))


class Scorer:
    """Log probabilities of texts. A text is cut at white space, which no word spans, and the sums of its tokens are remembered."""

    def __init__(self, vocabulary: str, probability: np.ndarray):
        self.segmenter = Segmenter(pieces_of(vocabulary), probability)
        self.languages = probability.shape[1]
        self.memory = Memory(REMEMBERED)

    def learn(self, tokens: list[str]) -> dict[str, bytes]:
        """The log probabilities of every token, as bytes; nothing for a token without words. Scores of known words are used again."""
        newer, older, found, cut = self.memory.newer, self.memory.older, {}, []
        for token in tokens:
            word = token.lower().strip(_MARKED)
            if word.isalpha():
                if value := newer.get(word) or older.get(word):
                    found[token] = value
                else:
                    cut.append((token, (word,)))
            else:
                cut.append((token, words_of(token)))
        words = list({w for _, c in cut for w in c})
        scores = self.segmenter.scores(words)
        size, raw = 8 * self.languages, scores.tobytes()
        known = {w: raw[k * size : (k + 1) * size] for k, w in enumerate(words)}
        for token, own in cut:
            if len(own) == 1:
                found[token] = known[own[0]]
            else:
                found[token] = np.frombuffer(b"".join(map(known.__getitem__, own))).reshape(-1, self.languages).sum(0).tobytes() if own else b""
        return found

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text the log probability in every language; None without letters."""
        cut = [t.split() if t else [] for t in texts]
        missing = self.memory.missing(set().union(*cut))
        known = self.memory.newer
        if missing:
            learned = self.learn(list(missing))
            worth = {t: v for t, v in learned.items() if len(t) <= 4 * STRETCH}
            self.memory.add(worth, (ENTRY + 8 * self.languages) * len(worth) + sum(map(len, worth)))
            if known is not self.memory.newer or len(worth) < len(learned):
                known = {t: known[t] for t in set().union(*cut).difference(missing)} | learned
        found = (b"".join(map(known.__getitem__, c)) for c in cut)
        return [np.frombuffer(f).reshape(-1, self.languages).sum(0) if f else None for f in found]


def identify(documents: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with ``held_out``, ``lang_pred`` and ``score``.

    ``lang_pred`` is the language with the largest probability of the whole text (ties: the first by code point),
    ``und`` for null, letter-free or unlearnable texts; ``score`` is its share among the languages, 0 for ``und``. Every
    text is read whole. Extra columns stay; input columns named like a result are replaced.
    """
    groups = learn(documents, vocabulary, sample, rounds)
    kept = [c for c in documents.columns if c not in ("held_out", "lang_pred", "score")]
    found = fresh(kept, "_found")[0]
    frame = documents.select(*kept, F.lit(None).cast(FOUND).alias(found))
    for names, probability in groups:
        frame = _scored(frame, found, vocabulary, names, probability)
    share = F.when(F.col(f"{found}.name").isNull(), 0.0).otherwise(1 / F.col(f"{found}.share"))
    name = F.coalesce(f"{found}.name", F.lit("und"))
    return frame.select(*kept, held_out(F.col("doc_id")).alias("held_out"), name.alias("lang_pred"), share.alias("score"))


FOUND = "struct<name: string, top: double, share: double>"  # the best language so far, its log probability, the sum of all languages' shares of it


def _scored(frame: DataFrame, found: str, vocabulary: str, names: list[str], probability: np.ndarray) -> DataFrame:
    """``frame`` with what was found so far of its texts, and after that the same with the languages ``names``."""
    key = ("languages", vocabulary, probability.tobytes())
    place, text = frame.columns.index(found), next(c for c in frame.columns if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strata.llm.tokens import slices

        scorer = held(key, lambda: Scorer(vocabulary, probability))
        for part in slices(batches, text):
            rows = []
            for total, own in zip(scorer.totals(part.column(text).to_pylist()), part.column(found).to_pylist()):
                if total is not None:
                    best, top = int(total.argmax()), own["top"] if own else -np.inf
                    most = max(top, float(total[best]))
                    here = float(np.exp(np.maximum(total - most, -700)).sum())
                    share = here + (own["share"] * float(np.exp(max(top - most, -700.0))) if own else 0.0)
                    own = {"name": names[best] if total[best] > top else own["name"], "top": most, "share": share}
                rows.append(own)
            yield part.set_column(place, part.schema.field(found), pa.array(rows, part.schema.field(found).type))
        trim()

    return frame.mapInArrow(run, frame.schema)
