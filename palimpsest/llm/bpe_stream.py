"""BPE encoding and decoding (operator 10): a transducer with bounded lookahead, and an incremental byte-to-text decoder.

A merge at the growing end of a text changes tokens to its left only through a chain of merges, each later in the list
than the one before and each taking the token to the left. `lookahead` bounds the bytes such a chain can span, so a token
that ends that far before the end of what was read is final. The encoder emits it and forgets it: memory depends on the merge list, not on the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

#: White space as the pattern of byte-level tokenizers has it.
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
RUNS = [regex.compile(rf"{c}*") for c in (r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]", rf"[{SPACE}]")]
CHARS = 1 << 16  # of a text, split into pretokens at a time
RUN = 1 << 12  # characters; a pretoken known to be shorter is handed on whole, a longer one in parts


class Bpe:
    """A merge list over bytes. vocab: bytes -> id; merges: pairs of bytes in order."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.vocab, self.special = vocab, special
        self.rank = {pair: k for k, pair in reversed(list(enumerate(merges)))}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.pieces = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of, default=-1) + 1)], pa.binary())
        self.lookahead = lookahead(merges)

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {chr(c): b for b, c in tokens.BYTE_CHARS.items()}
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(vocab, [(raw(a), raw(b)) for a, b in merges], special)

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of data taken alone: the first of the earliest pairs merges, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return parts

    def ids(self, data: bytes) -> list[int]:
        return [self.vocab[t] for t in self.merge(data)]


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token cannot change, however the text goes on.

    reach of a merge (z, f): bytes that can still differ, from z's start, once it has happened at the end or failed to. The token left
    of z is touched next only by a later merge (y, t) whose t starts where z does, so has z as a prefix.
    """
    later: dict[bytes, int] = {}  # prefix of a right side -> longest reach among merges seen, which come later
    most = longest = 1
    for z, f in reversed(merges):
        reach = len(z) + later.get(z, 0)
        most, longest = max(most, reach), max(longest, len(z) + len(f))
        for n in range(1, len(f) + 1):
            if later.get(f[:n], 0) < reach:
                later[f[:n]] = reach
    return most + 2 * longest


class Transducer:
    """Bytes of one pretoken in, tokens out as soon as they are stable; holds at most two lookaheads and what is fed at once."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, b""

    def feed(self, data: bytes) -> Iterator[int]:
        ahead = self.bpe.lookahead
        for k in range(0, len(data), ahead):
            self.held += data[k : k + ahead]
            if len(self.held) < 2 * ahead:
                continue
            at = 0
            for t in self.bpe.merge(self.held):
                if at + len(t) > len(self.held) - ahead:
                    break
                yield self.bpe.vocab[t]
                at += len(t)
            self.held = self.held[at:]

    def end(self) -> Iterator[int]:
        yield from self.bpe.ids(self.held)
        self.held = b""


def pretokens(text: str, chars: int = CHARS, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """(part, whether its pretoken ends with it), of a text without special tokens, read in blocks of a fixed length.

    What a block's last two pretokens are can depend on what follows, so they wait for the next block. A long run of characters of
    one class is handed on in parts; of white space the last character waits, as it may join what follows.
    """
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + chars)
        found = [m.end() for m in PRETOKEN.finditer(text, at, stop)]
        sure = found if stop == n else found[:-2]
        for end in sure:
            yield text[at:end], True
            at = end
        if stop == n or sure:
            continue
        white = _kind(text, at) == 3
        end = found[0] if len(found) > 1 and found[0] - at < run and not white else _run_end(text, at, n)
        if white and end < n:  # all but the last white space belong together, unless there is only one
            end = max(at + 1, end - 1)
        for a in range(at, end, chars):
            yield text[a : min(end, a + chars)], a + chars >= end
        at = end


def _kind(text: str, at: int) -> int:
    at += text[at] == " " and at + 1 < len(text) and not RUNS[3].fullmatch(text[at + 1])
    return next(k for k in (0, 1, 3, 2) if RUNS[k].fullmatch(text[at]))


def _run_end(text: str, at: int, n: int) -> int:
    kind = _kind(text, at)
    end = at + (text[at] == " " and kind != 3)
    while end < n and (step := RUNS[kind].match(text, end, min(n, end + CHARS)).end()) > end:
        end = step
    return end


def encode(bpe: Bpe, text: str, machine: Transducer | None = None) -> Iterator[int]:
    """Ids of a whole text: special tokens are cut out first, then pretokens, whose bytes go through the transducer."""
    machine = machine or Transducer(bpe)
    marks = regex.compile("(" + "|".join(map(regex.escape, bpe.special)) + ")") if bpe.special else None
    for k, part in enumerate(marks.splititer(text) if marks else [text]):
        if k % 2:
            yield bpe.special[part]
            continue
        for piece, ends in pretokens(part):
            yield from machine.feed(piece.encode())
            if ends:
                yield from machine.end()


class Decoder:
    """Ids in, text out: bytes of an unfinished character wait for the next id; damaged ones become U+FFFD."""

    def __init__(self, bpe: Bpe):
        self.pieces, self.machine = bpe.pieces, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        found = self.pieces.take(pa.array(ids, pa.int64()))
        if found.null_count:
            raise ValueError("an id that the vocabulary lacks")
        ends = np.frombuffer(found.buffers()[1], np.int32)
        return self.machine.decode(memoryview(found.buffers()[2])[ends[0] : ends[len(found)]])

    def end(self) -> str:
        return self.machine.decode(b"", True)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe.from_file(path)
    return _loaded[path]


def coder(path: str) -> tokens.Coder:
    """Pretokens recur: each goes through the transducer when it is first met, and what came out is remembered (within bounds)."""
    bpe = load(path)
    machine = Transducer(bpe)

    def pretoken(word: str) -> bytes:
        out = array("I", machine.feed(word.encode()))
        out.extend(machine.end())
        return out.tobytes()

    words = tokens.Words(pretoken)

    def many(pieces: list[str]) -> list[bytes]:
        words.trim()
        return [b"".join(map(words.__getitem__, tokens.SPLIT.findall(p))) if tokens.SIMPLE.fullmatch(p) and "<|" not in p else array("I", encode(bpe, p, machine)).tobytes() for p in pieces]

    return tokens.Coder(tokens.byte_level, tokens.byte_level_piece, many)


def stable_blocks(text: str, chars: int = CHARS) -> Iterator[tuple[str, bool]]:
    """A text in blocks of at most so many characters, which end where a token starts whatever follows: before a single space between
    others. A stretch without such a place is handed over whole and marked True, to be streamed."""
    at, n = 0, len(text)
    while n - at > chars:
        end = text.rfind(" ", at + 1, at + chars)
        while end > at and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.rfind(" ", at + 1, end)
        if end <= at:
            m = tokens.SAFE_CUT.search(text, at + chars - 1)
            end = m.start() if m else n
            yield text[at:end], True
        else:
            yield text[at:end], False
        at = end
    if at < n or not n:
        yield text[at:], False


PART = 1 << 15  # ids of a row of a streamed stretch
PARTS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])


def _encoded(texts: list[str], bpe: Bpe, ids_of: tokens.Coder) -> Iterator[tuple[int, int, bytes]]:
    """(number of the text, part, ids), in order; blocks of the texts are encoded together up to tokens.BATCH_BYTES."""
    waiting: list[tuple[int, int, str]] = []
    size, parts = 0, 0

    def done() -> Iterator[tuple[int, int, bytes]]:
        found = (x for some in ids_of(pa.array([b for _, _, b in waiting], pa.string())) for x in some.to_pylist())
        yield from ((k, part, x) for (k, part, _), x in zip(waiting, found, strict=True))

    for k, text in enumerate(texts):
        parts = 0
        for block, long in stable_blocks(text):
            if long:
                yield from done()
                waiting, size, stream = [], 0, encode(bpe, block)
                while some := array("I", islice(stream, PART)):
                    yield k, parts, some.tobytes()
                    parts += 1
                continue
            waiting.append((k, parts, block))
            parts, size = parts + 1, size + len(block)
            if size >= tokens.BATCH_BYTES:
                yield from done()
                waiting, size = [], 0
    yield from done()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, part, ids binary): each whole text (null: empty) as little-endian unsigned 32-bit ids, in parts of bounded size.

    The parts of a text are consecutive rows from part 0 up; a text of up to CHARS characters, the empty one too, has one."""
    path = path or tokens.vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bpe = coder(path), load(path)
        for batch in common.slices(batches):
            ids, found = batch.column(0).to_pylist(), _encoded(batch.column(1).to_pylist(), bpe, ids_of)
            while some := list(islice(found, 4096)):
                yield pa.RecordBatch.from_pydict({"doc_id": [ids[k] for k, _, _ in some], "part": [p for _, p, _ in some], "ids": [x for _, _, x in some]}, schema=PARTS)

    return common.texts(docs).mapInArrow(run, "doc_id long, part int, ids binary")


def decode_documents(parts: DataFrame, path: str | None = None) -> DataFrame:
    """Of encode_documents' rows: (doc_id, n_tokens, ids_sha256, decoded_sha256); ids and text pass through their digests part by part.

    The parts of a document must follow each other as they do there; a partition that begins in the middle of one is refused.
    """
    path = path or tokens.vocabulary("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, now, rows = load(path), None, []

        def close() -> None:
            if now is not None:
                now[4].update(now[2].end().encode())
                rows.append((now[0], now[1], now[3].hexdigest(), now[4].hexdigest()))

        for batch in common.slices(batches):
            for i, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    close()
                    now = [i, 0, Decoder(bpe), hashlib.sha256(), hashlib.sha256()]
                elif now is None or now[0] != i:
                    raise ValueError("parts of a document are apart")
                now[1] += len(raw) // 4
                now[3].update(raw)
                now[4].update(now[2].feed(np.frombuffer(raw, "<u4")).encode())
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)
            rows.clear()
        close()
        yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)

    return parts.select("doc_id", "part", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decode_documents(encode_documents(common.documents(spark, sf_dir)))
