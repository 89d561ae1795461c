"""Whole texts to ids as the tokenizers library gives them, by pieces that never share a token, each encoded once.

A text is cut only where the tokenizer always starts a new token, so the ids of a text are those of its pieces in turn.
Pieces recur: Arrow cuts the texts and numbers the different pieces, Python sees each of these once, and Arrow lays their ids
(little-endian unsigned 32-bit integers) out in the order of the texts. A bounded memo keeps what was encoded before. Pieces with
signs beyond Latin-1 are encoded many at a time, with a special token between them: the library encodes what lies between special
tokens as texts of their own.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_ENTRIES = 250_000
LONG_PIECE = 256  # longer ones are encoded with their batch and not remembered
TOGETHER = 20_000  # pieces, or
BATCH_BYTES = 8 << 20  # bytes of texts, handled at a time


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a file, once for each Python worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    t = library(path)
    mark, mark_id = next((x.content, i) for i, x in sorted(t.get_added_tokens_decoder().items()) if x.special)

    def encode(pieces: list[str]) -> list[bytes]:
        if any(mark in p for p in pieces):
            return [array("I", t.encode(p, add_special_tokens=False).ids).tobytes() for p in pieces]
        ids = np.array(t.encode_batch_fast([mark.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = [*np.flatnonzero(ids == mark_id), len(ids)]
        raw, out, a = ids.tobytes(), [], 0
        for b in ends:
            out.append(raw[4 * a : 4 * b])
            a = b + 1
        return out

    return encode


#: ASCII and the letters of Latin-1: there the library's patterns and normalisers do what SPLIT and lower() do.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIMPLE = re.compile(rf"[\n ]?[!-~{LETTER}]+")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\n")
SPLIT_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")
BYTE_CHARS = [c if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174 else None for c in range(256)]
BYTE_CHARS = {c: x if x is not None else 256 + sum(y is None for y in BYTE_CHARS[:c]) for c, x in enumerate(BYTE_CHARS)}


class Words(dict):
    """word -> ids, encoded when first asked for; trim() bounds it."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()


def model_encoder(path: str, split: re.Pattern, lower: bool) -> Callable[[list[str]], list[bytes]]:
    """The library's merges for simple pieces, its whole chain for others."""
    model, full = library(path).model, library_encoder(path)

    words = Words(lambda w: array("I", [x.id for x in model.tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes())

    def encode(pieces: list[str]) -> list[bytes]:
        out, other = [], []
        words.trim()
        for k, p in enumerate(pieces):
            if SIMPLE.fullmatch(p) and "<|" not in p:
                out.append(b"".join(map(words.__getitem__, split.findall(p.lower() if lower else p))))
            else:
                out.append(b"")
                other.append(k)
        if other:
            for k, ids in zip(other, full([pieces[k] for k in other]), strict=True):
                out[k] = ids
        return out

    return encode


#: White space other than single spaces and line ends between two other characters: cuts there aren't safe for byte-level tokenizers.
#: With NUL, which marks a piece that has no space before it.
UNSAFE = r"[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\n[ \n]| [ \n]|[ \n]$"
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_level(texts: pa.Array) -> pa.ListArray:
    """Byte-level BPE with the usual pattern: a space or line end between two other characters starts a token.

    A piece has lost its space; NUL stands before one that had none, a line end stays."""
    unsafe = pc.match_substring_regex(texts, UNSAFE)
    marked = pc.binary_join_element_wise("\0", texts, "")
    pieces = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
    if not pc.any(unsafe).as_py():
        return pieces
    own = iter([_byte_level(t) for t in texts.filter(unsafe).to_pylist()])
    merged = [next(own) if bad else None for bad in unsafe.to_pylist()]
    return pc.if_else(unsafe, pa.array(merged, pieces.type), pieces)


def _byte_level(text: str) -> list[str]:
    if "\0" in text:
        return ["\0" + text]
    first, *others = SAFE_CUT.split(text)
    return ["\0" + first, *(p[1:] if p[0] == " " else p for p in others)]


def byte_level_piece(p: str) -> str:
    """The text of a piece."""
    return p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p


def white_space_free(texts: pa.Array) -> pa.ListArray:
    """For tokenizers that drop white space and never join tokens across it: ASCII white space parts the pieces."""
    return pc.ascii_split_whitespace(texts)


class Coder:
    """Texts to ids. cut: a list of pieces for each text; whole: the text that a piece stands for; encode: ids of many pieces."""

    def __init__(self, cut: Callable[[pa.Array], pa.ListArray], whole: Callable[[str], str], encode: Callable[[list[str]], list[bytes]], entries: int = MEMO_ENTRIES):
        self.cut, self.whole, self.encode, self.entries = cut, whole, encode, entries
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> Iterator[pa.BinaryArray]:
        """The ids of consecutive texts (none null), in arrays of some of them."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_BYTES, "right")))
            yield self._some(texts.slice(a, b - a))
            a = b

    def _some(self, texts: pa.Array) -> pa.BinaryArray:
        pieces = self.cut(texts)
        coded = pieces.flatten().dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        ends = np.r_[0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))]
        if not len(ids):
            return pa.array([b""] * len(texts), pa.binary())
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1][ends]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at)), ids.buffers()[2]])

    def _known(self, pieces: list[str]) -> list[bytes]:
        if len(self.memo) > self.entries:  # what is asked for again comes back from the older half
            self.older, self.memo = self.memo, {}
        out = [*map(self.memo.get, pieces)]
        gaps = [k for k, x in enumerate(out) if x is None]
        found = [*map(self.older.get, map(pieces.__getitem__, gaps))]
        missing = [k for k, x in zip(gaps, found, strict=True) if x is None]
        for k, x in zip(gaps, found, strict=True):
            out[k] = x
        for a in range(0, len(missing), TOGETHER):
            some = missing[a : a + TOGETHER]
            for k, x in zip(some, self.encode([self.whole(pieces[k]) for k in some]), strict=True):
                out[k] = x
        self.memo.update((pieces[k], out[k]) for k in gaps if len(pieces[k]) <= LONG_PIECE)
        return out


def coded(coder: Coder, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(id, ids of its text) for a batch of (id, text)."""
    at = 0
    for ids in coder(batch.column(1)):
        yield from zip(batch.column(0).slice(at, len(ids)).to_pylist(), ids.to_pylist(), strict=True)
        at += len(ids)


def byte_level_coder(path: str) -> Coder:
    return Coder(byte_level, byte_level_piece, model_encoder(path, SPLIT, lower=False))


def white_space_free_coder(path: str) -> Coder:
    return Coder(white_space_free, str, model_encoder(path, SPLIT_WORD, lower=True))
