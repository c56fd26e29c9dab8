"""Exact token ids of whole texts with the tokenizers library, each distinct stretch of text encoded once in a while.

A text is cut at single spaces where no token of the tokenizer can span the cut: a word-level tokenizer drops white
space, a byte-level one starts a new piece at a space before a word. So the ids of the text are the ids of its
stretches, and a stretch seen before is looked up. A plain stretch (Latin letters, perhaps with marks after them) is
known to be a word and a run of marks, which go to the tokenizer's model without its normaliser and its splitting
pattern. Cutting, looking up and joining are calls of Arrow on all texts of a batch, so Python handles only what is
new. What is remembered is bounded by bytes.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strata.llm.held import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED = 16 << 20  # bytes that a worker remembers: more take longer to look up than they save
LONGEST = 64  # bytes of a name worth remembering
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
# Two characters that Python's \s matches, for Arrow's expressions.
_SPACE_RUN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
# Latin letters that neither normalisation nor lower-casing changes in number, and a run of ASCII marks, which is a piece of its own.
_LETTERS, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]", r"[!-/:-@\[-`{-~]"
_PLAIN = rf"\A(?P<first>[\n\x00]?)(?P<word>{_LETTERS}+)(?P<marks>{_MARKS}*)\z"
_WITHIN_PLAIN = re.compile(rf"[\n\0]?{_LETTERS}*{_MARKS}*")
_OTHER = "\1"  # before the name of a stretch that is not plain
# Byte-level vocabularies write printable bytes as themselves and the others, in order, from character 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_UNPRINTABLE = iter(range(256, 512))
_BYTES = np.array([b if b in _PRINTABLE else next(_UNPRINTABLE) for b in range(256)], "<u4")


def _bytes_of(pieces: str) -> list[str]:
    """Pieces, parted by line breaks, in the letters of byte-level vocabularies."""
    return _BYTES[np.frombuffer(pieces.encode(), np.uint8)].tobytes().decode("utf-32-le").split(chr(_BYTES[10]))


def _binary(values: list[bytes]) -> pa.LargeBinaryArray:
    return pa.array(values, pa.large_binary())


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library gives them without added special tokens.

    Strings of special tokens within a text are those tokens, unless ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.keeps_space = one("a b") != one("a") + one("b")
        special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t for t in special if _WITHIN_PLAIN.fullmatch(t)]  # those that a plain stretch can hold
        self.pieces = Tokenizer(self.tokenizer.model)  # the model alone
        vocabulary, end = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.model.end_of_word_suffix or ""
        self.widths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)  # characters of every id
        self.widths[list(vocabulary.values())] = [len(t.removesuffix(end)) for t in vocabulary]
        self.marks: dict[str, bytes] = {}
        self.names, self.ids, self.used = pa.array([], pa.large_string()), _binary([]), np.zeros(0, bool)  # what is remembered

    def _cut(self, texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The stretches of all texts, and the places in them where each text begins and ends.

        Of a byte-level tokenizer, a text's first stretch follows a NUL and the others are without their first space;
        a text that holds a NUL is not cut.
        """
        if not self.keeps_space:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            bounds = cut.offsets.to_numpy()
            return cut.flatten(), bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        nul, nothing = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        apart = pc.or_(pc.match_substring_regex(texts, _SPACE_RUN), pc.match_substring(texts, "\0"))
        # A lone line break is a piece of its own.
        cut = pc.split_pattern(pc.binary_join_element_wise(nul, pc.replace_substring(texts.filter(pc.invert(apart)), "\n", " \n"), nothing), " ")
        others = [["\0" + t] if "\0" in t else _INNER_SPACE.split("\0" + t) for t in texts.filter(apart).to_pylist()]
        apart = apart.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), np.int64)
        sizes[~apart], sizes[apart] = np.diff(cut.offsets.to_numpy()), [len(o) for o in others]
        order = np.argsort(apart, kind="stable")  # the stretches of these texts come last
        ends = np.zeros(len(texts), np.int64)
        ends[order] = np.cumsum(sizes[order])
        return pa.concat_arrays([cut.flatten(), *(pa.array(o, pa.large_string()) for o in others)]), ends - sizes, ends

    def _written(self, stretch: str) -> str:
        """What a stretch stands for in its text."""
        if not self.keeps_space or stretch[:1] == "\n":
            return stretch
        return stretch[1:] if stretch[:1] == "\0" else f" {stretch}"

    def _parts(self, stretches: pa.LargeStringArray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of every stretch the line break before it, the name of what is remembered, and the marks after it.

        The name of a plain stretch is its word, in a byte-level tokenizer with the space that it stands for.
        """
        empty = pa.scalar("", pa.large_string())
        found = pc.extract_regex(stretches, _PLAIN)
        plain = found.is_valid()
        for special in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(stretches, special)))
        if not self.keeps_space:  # such characters are no signs of the cut
            plain = pc.and_(plain, pc.fill_null(pc.equal(pc.struct_field(found, 0), ""), False))
        first, word, marks = (pc.if_else(plain, pc.struct_field(found, k), empty) for k in range(3))
        if self.keeps_space:
            word = pc.binary_join_element_wise(pc.if_else(pc.equal(first, ""), pa.scalar(" ", pa.large_string()), empty), word, empty)
        other = pc.binary_join_element_wise(pa.scalar(_OTHER, pa.large_string()), stretches, empty)
        return pc.if_else(pc.equal(first, "\n"), first, empty), pc.if_else(plain, word, other), marks

    def _learn(self, names: pa.LargeStringArray, plain: int) -> pa.LargeBinaryArray:
        """The ids of every name; the first ``plain`` are of plain stretches."""
        names = names.to_numpy(zero_copy_only=False).tolist()
        others = [self._written(n[1:]) for n in names[plain:]]
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        ids = _binary([array("I", e.ids).tobytes() for e in encoded])
        if not plain:
            return ids
        words = "\n".join(names[:plain])
        return pa.concat_arrays([self._words(_bytes_of(words if self.keeps_space else words.lower())), ids])

    def _words(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """The model's ids of every piece: encoded in a row and parted by the characters that ids stand for."""
        (coded,) = self.pieces.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, "<u4")
        upto, wanted = np.cumsum(self.widths[ids]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if not len(ids) or upto[-1] != wanted[-1]:  # the vocabulary lacks a character
            return _binary([self._piece(p) for p in pieces])
        ends = np.append(0, 4 * (np.searchsorted(upto, wanted) + 1)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _marks(self, marks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of short runs of marks or of line breaks, of which there are few."""
        coded = marks.dictionary_encode()
        found = []
        for run in coded.dictionary.to_pylist():
            if run not in self.marks:
                if len(self.marks) > 4096:
                    self.marks.clear()
                self.marks[run] = self._piece("".join(map(chr, _BYTES[list(run.encode())])))
            found.append(self.marks[run])
        return _binary(found).take(coded.indices)

    def _known(self, names: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct ``names``; new ones are learned and remembered."""
        at = pc.index_in(names, value_set=self.names)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        places = at.fill_null(0).to_numpy().astype(np.int64)
        self.used[places[known]] = True
        if known.all():
            return self.ids.take(pa.array(places))
        other = pc.starts_with(names, _OTHER).to_numpy(zero_copy_only=False)
        new = np.concatenate([np.flatnonzero(~known & ~other), np.flatnonzero(~known & other)])
        places[new] = len(self.names) + np.arange(len(new))
        learned = names.take(pa.array(new))
        ids = self._learn(learned, int((~known & ~other).sum()))
        found = pa.concat_arrays([self.ids, ids]).take(pa.array(places))
        self._remember(learned, ids)
        return found

    def _remember(self, names: pa.LargeStringArray, ids: pa.LargeBinaryArray) -> None:
        """Remember names that are not too long. When there are too many, those stay that were asked for again, or else the newest of them."""
        short = pc.less_equal(pc.binary_length(names), LONGEST)
        names, ids = names.filter(short), ids.filter(short)
        used = np.append(self.used, np.zeros(len(names), bool))
        names, ids = pa.concat_arrays([self.names, names]), pa.concat_arrays([self.ids, ids])
        sizes = (pc.binary_length(names).to_numpy() + pc.binary_length(ids).to_numpy()).astype(np.int64) + 17  # two offsets and a flag
        if sizes.sum() > REMEMBERED:
            stays = np.flatnonzero(used)
            newest = np.cumsum(sizes[stays][::-1])[::-1] <= REMEMBERED // 2
            kept = pa.array(stays[newest])
            names, ids, used = names.take(kept), ids.take(kept), np.zeros(len(kept), bool)
        self.names, self.ids, self.used = names, ids, used

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of every text; null is empty."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        stretches, starts, ends = self._cut(pc.fill_null(texts, ""))
        coded = stretches.dictionary_encode()
        line, name, marks = self._parts(coded.dictionary)
        named = name.dictionary_encode()
        own = self._known(named.dictionary).take(named.indices)
        ids = pc.binary_join_element_wise(self._marks(line), own, self._marks(marks), pa.scalar(b"", pa.large_binary())).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        joined = memoryview(ids.buffers()[2] or b"")
        return [bytes(joined[a:b]) for a, b in zip(at[starts].tolist(), at[ends].tolist())]


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return held(("tokens", path, special_as_text), lambda: Encoder(path, special_as_text))


def slices(batches, texts: str, most_rows: int = 256, most_bytes: int = 4 << 20):
    """Cut Arrow batches into slices of bounded size (one very long text makes a slice of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(texts).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            upto = at + 1
            total = sizes[at]
            while upto < min(batch.num_rows, at + most_rows) and total + sizes[upto] <= most_bytes:
                total += sizes[upto]
                upto += 1
            yield batch.slice(at, upto - at)
            at = upto
