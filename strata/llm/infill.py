"""Fill-in-the-middle texts, cut at places that a Fenwick tree over the blocks of a text finds.

A text is a sequence of units: runs of the letters A-Z and a-z, and every other code point by itself. The tree holds how
many units begin in each block of code points, and how many code points it has; a descent by powers of two finds the
block in which a given unit begins, and only that block is looked at again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.names import fresh

BLOCK = 4096  # code points
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # hundredths: from here on a text stays plain; below this one it is suffix first
RESULTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def beginnings(block: str, after_letter: bool) -> np.ndarray:
    """Whether a unit begins at each code point; ``after_letter``: the one before the block is a letter."""
    codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
    before = np.empty_like(letter)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return ~(letter & before)


class UnitTree:
    """Unit and code point counts of the blocks of one text as a Fenwick tree."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        self.blocks = -(-len(text) // block)
        self.units, self.chars = [0] * (self.blocks + 1), [0] * (self.blocks + 1)
        self.n = 0
        for i in range(1, self.blocks + 1):
            own = self._begins(i - 1)
            here = int(own.sum())
            self.n += here
            self.units[i] += here
            self.chars[i] += len(own)
            if (up := i + (i & -i)) <= self.blocks:  # all that belongs to i is in: hand it on
                self.units[up] += self.units[i]
                self.chars[up] += self.chars[i]

    def _begins(self, block: int) -> np.ndarray:
        at = block * self.block
        before = self.text[at - 1 : at] if at else ""
        return beginnings(self.text[at : at + self.block], before.isascii() and before.isalpha())

    def place(self, unit: int) -> int:
        """The code point at which a unit (from 0) begins; the end of the text for the number of units or more."""
        block = at = 0
        step = 1 << self.blocks.bit_length() >> 1
        while step:
            if (up := block + step) <= self.blocks and self.units[up] <= unit:
                block, unit, at = up, unit - self.units[up], at + self.chars[up]
            step >>= 1
        return at if block == self.blocks else at + int(np.flatnonzero(self._begins(block))[unit])


def draws(key: int | None) -> tuple[int, ...]:
    """The four numbers that decide about a document: the first 8-digit groups of the SHA-256 of ``1:`` and its key."""
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in range(0, 32, 8))


def infill(key: int | None, text: str, block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    tree = UnitTree(text, block)
    one, two, plain, order = draws(key)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or plain % 100 >= PLAIN_FROM:
        return tree.n, "plain", None, None, text
    first, last = sorted((one % (tree.n + 1), two % (tree.n + 1)))
    a, b = tree.place(first), tree.place(last)
    if order % 100 < SPM_BELOW:
        return tree.n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return tree.n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``documents`` with ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    The key alone draws the cuts and the form. Texts that are null (taken as empty), empty or hold one of the marks stay
    plain, and so do a tenth of the others; plain texts have null ``prefix_chars`` and ``middle_chars``. A row without
    key is drawn as if its key were the empty string. Repeated rows give repeated results; an empty table gives no rows.
    Every row is worked out by itself, in memory for its text, its output and a few numbers per block. ``carry`` names
    the input columns to keep (default: all); those named like a result are replaced.
    """
    kept = [c for c in documents.columns if (carry is None or c in carry) and c not in RESULTS]
    own_key, own_text = fresh(kept, "_key", "_text")
    inputs = documents.select(*kept, F.col(key).alias(own_key), F.col(text).alias(own_text))

    def run(batches):
        from strata.llm.tokens import slices

        for part in slices(batches, own_text):
            keys, texts = part.column(own_key).to_pylist(), part.column(own_text).to_pylist()
            found = zip(*(infill(k, t or "", block) for k, t in zip(keys, texts)))
            results = [pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, kind in zip(found, RESULTS.values())]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in range(len(kept))] + results, names=[*kept, *RESULTS])

    schema = inputs.select(*kept).schema
    for name, kind in RESULTS.items():
        schema = schema.add(name, kind)
    return inputs.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: the parts between its marks in their first order."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
