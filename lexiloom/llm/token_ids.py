"""Byte-level BPE ids of whole texts by the tokenizers library, a block of texts at a time.

The pre-tokenizer of the byte-level vocabularies never joins a character that is not white space with white space that
follows it, and of a run of two blanks or line feeds the first stands alone. So a text may be cut before every blank and
every line feed, and the ids of the text are the ids of its chunks, one after the other. Arrow cuts all texts of a
block at once and numbers the different chunks; each of these is encoded once, and the ids are gathered by numpy. What is
held is bounded by the block and by the chunks that are known from blocks before, of which there are at most ``KNOWN``
and a block's.

Texts with longer runs, with other white space, with the name of a special token or with the mark of a text's first
chunk go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexiloom.llm.workers import blocks

#: Bytes of texts whose chunks are numbered together, and ids that are gathered together; one longer text is a block.
BLOCK_BYTES, GATHERED = 16_000_000, 2_000_000
#: What marks the first chunk of a text, which nothing stands before.
_FIRST = "\x02"
#: What can't be cut as above: other white space, runs of three or of two at the end, and the mark itself.
_WHOLE = r"[\x02\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{3}|[ \n]{2}\z"
#: Letters that every version of Unicode's tables has as such, and marks that end a word.
_LETTERS, _MARKS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", ".,;:!?"
#: Chunks whose ids are kept from block to block, about 60 bytes each.
KNOWN = 1_000_000


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: a printable Latin-1 byte is itself, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: 0x100 + n for n, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ids that start there and are so long, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class BlockEncoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._feed = int(self._library(["\n"])[0][0])
        self._marks = {x: self._library([x])[0][0] for x in _MARKS}
        #: The known chunks' names, their ids one after the other, where each one's begin and how many it has.
        self._names, self._ids = pa.array([], pa.string()), np.empty(0, np.uint32)
        self._starts = self._sizes = np.empty(0, np.int64)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _encoded(self, words: list[str], plain: list[bool], lead: str) -> list[list[int]]:
        """Ids of each word, after ``lead``, a blank or nothing. A plain word is one token of the pre-tokenizer, and meets
        the model as that."""
        tokenize, start = self._model.tokenize, "\u0120" if lead else ""
        out: list[list[int]] = [[]] * len(words)
        others = []
        for i, (word, alone) in enumerate(zip(words, plain, strict=True)):
            if alone:
                mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
                out[i] = [t.id for t in tokenize(start + mapped)]
            elif word or lead:
                others.append(i)
        for i, found in zip(others, self._tokenizer.encode_batch_fast([lead + words[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def _learned(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks that are named, one after the other, and how many each has.

        A name is a word after a blank, or a line feed or the mark of a first chunk and a word.
        """
        plain = pc.match_substring_regex(names, rf"\A[\x02\n]?{_LETTERS}+\z").to_numpy(zero_copy_only=False)
        first, fed = (pc.starts_with(names, x).to_numpy(zero_copy_only=False) for x in (_FIRST, "\n"))
        words = pc.replace_substring_regex(names, r"\A[\x02\n]", "")
        found: list[list[int]] = [[]] * len(names)
        for which, lead in ((first | fed, ""), (~first & ~fed, " ")):
            of = np.flatnonzero(which)
            for i, ids in zip(of.tolist(), self._encoded(words.take(pa.array(of)).to_pylist(), plain[of].tolist(), lead), strict=True):
                found[i] = ids
        for i in np.flatnonzero(fed).tolist():
            found[i] = [self._feed, *found[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _known(self, names: pa.Array) -> np.ndarray:
        """The number of each name among the known ones; new ones become known. Beyond ``KNOWN`` only those of now stay."""
        at = pc.index_in(names, value_set=self._names)
        new = names.filter(pc.is_null(at))
        if len(self._names) + len(new) > KNOWN and len(self._names):
            stay = pc.drop_null(at).to_numpy()
            ids, sizes = _gathered(self._ids, self._starts[stay], self._sizes[stay]), self._sizes[stay]
            self._names, self._ids, self._sizes, self._starts = self._names.take(pa.array(stay)), ids, sizes, np.cumsum(sizes) - sizes
            at = pc.index_in(names, value_set=self._names)
        if len(new):
            ids, sizes = self._learned(new)
            places = at.to_numpy(zero_copy_only=False).copy()
            places[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self._names) + np.arange(len(new))
            self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
            self._names, self._ids, self._sizes = pa.concat_arrays([self._names, new]), np.concatenate([self._ids, ids]), np.concatenate([self._sizes, sizes])
            return places.astype(np.int64)
        return at.to_numpy().astype(np.int64)

    def _chunks(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks that are named, where each one's begin and how many it has. Letters and the one mark that ends
        them are two tokens of the pre-tokenizer: the chunk is the letters' and the mark's id."""
        ended = pc.match_substring_regex(names, rf"\A[\x02\n]?{_LETTERS}+[{_MARKS}]\z")
        heads = pc.if_else(ended, pc.utf8_slice_codeunits(names, 0, -1), names).dictionary_encode()
        at = self._known(heads.dictionary)[heads.indices.to_numpy()]
        marks = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
        last = pc.utf8_slice_codeunits(names.take(pa.array(marks)), -1)
        sizes = self._sizes[at]
        ids = _gathered(self._ids, self._starts[at], sizes)
        after = (np.cumsum(sizes))[marks]
        ids = np.insert(ids, after, np.array([self._marks[x] for x in last.to_pylist()], dtype=np.uint32))
        sizes = sizes.copy()
        sizes[marks] += 1
        return ids, np.cumsum(sizes) - sizes, sizes

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, _WHOLE)
        for name in self._special:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        apart = iter(self._library(texts.filter(whole).to_pylist()))
        marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), "")
        split = pc.split_pattern(marked, " ")
        numbered = pc.dictionary_encode(split.flatten())
        ids, starts, sizes = self._chunks(numbered.dictionary)
        chunks = numbered.indices.to_numpy()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        tokens = np.append(0, np.cumsum(sizes[chunks]))[bounds]  # where each text's ids begin
        alone, row = whole.to_numpy(zero_copy_only=False).tolist(), 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(tokens, tokens[row] + GATHERED, "right")) - 1)
            some = chunks[bounds[row] : bounds[last]]
            got = _gathered(ids, starts[some], sizes[some])
            for i in range(row, last):
                yield next(apart) if alone[i] else got[tokens[i] - tokens[row] : tokens[i + 1] - tokens[row]]
            row = last

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> Iterator[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit bytes, with end_id appended if given."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for a, b in blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK_BYTES):
            for ids in self._block(texts.slice(a, b - a)):
                yield ids.astype("<u4", copy=False).tobytes() + end


_ENCODERS: dict[str, BlockEncoder] = {}


def encoder(path: str) -> BlockEncoder:
    """The worker's encoder of that vocabulary file; one at a time."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = BlockEncoder(path)
    return _ENCODERS[path]
