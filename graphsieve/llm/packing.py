"""Cost-balanced packing of tokenized documents into training sequences.

A piece of L tokens is estimated to cost `linear * L + quadratic * L * L`. Documents are cut into slices of the capacity and a rest. Within
a window of documents, slices and rests go in descending cost to the sequence of least cost that still has room for the whole
piece; when none has, the piece is cut at the end of the roomiest one. Windows are bounded stretches of an input partition, so no
document is shuffled or collected. What does not fill a sequence moves on to the next window, and at the end of a partition
to a second pass over these tails, fewer than `capacity` tokens a partition, which are packed in the same way by few tasks, and by
fewer again until one is left. So all sequences together need less padding than one sequence holds.

Pieces are stored as the first pass makes them, so that the second one sees what was packed.

Defined cases: a null or empty text is the end token alone; a null doc_id is kept as null; rows that repeat a doc_id are
packed one by one; of equal costs the earlier row goes first, of equal sequences the first one gets it; other columns are not
looked at; an empty table gives no rows. A text longer than a window is a window of its own.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import textblocks as tb
from graphsieve.llm.store import small_batches, written

CAPACITY = 2048
WINDOW_TOKENS = 1_000_000
#: Of tails that one task of the second pass gets, 4 bytes each.
TAIL_TOKENS = 8_000_000
END_ID = 1
CACHED_WORDS = 400_000
#: Of texts that are encoded together.
BLOCK_BYTES = 8 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_ASCII_WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall
#: ASCII but for the apostrophe, Latin letters whose lower case is one letter, and white space; and how the tokenizer cuts such texts.
_SIMPLE = re.compile(r"[ -&(-~\t\n\r\x0b\x0c\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*").fullmatch
_SIGNS = r"[0-9]|[!-/:-@\[-`{-~]+"
_PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, without special tokens.

    The tokenizer drops white space and cuts a text into letters, digits and signs, whose ids do not depend on one another. Texts of simple
    letters, without apostrophes or marks of special tokens, are cut here, and the parts' ids are remembered; of other texts the words are
    looked at one by one, and those that are not simple go to the tokenizer whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.parts = _Remembered(self._part)
        self.words = _Remembered(self._word)
        self.bytes_as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        shown = part if part.isascii() else self.bytes_as_text(part)[0][0]
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if _SIMPLE(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _PARTS(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _SIMPLE(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, _PARTS(text.lower())))
        return b"".join(map(self.words.__getitem__, _ASCII_WORDS(text)))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The same of many texts: simple ones are cut together, and each distinct part of them is looked at once."""
        given = texts.to_pylist()
        simple = [bool(t and _SIMPLE(t) and "<|" not in t) for t in given]
        out = [b"" if s else self.encode(t) for s, t in zip(simple, given, strict=True)]
        chosen = pc.utf8_lower(texts.filter(pa.array(simple, pa.bool_())))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(chosen, _SIGNS, r" \0 "))
        parts = cut.flatten().dictionary_encode()
        ids = pa.array([self.parts[p] for p in parts.dictionary.to_pylist()], pa.binary()).take(parts.indices)
        _, where, data = ids.buffers()
        if data is None:
            return out
        ends = np.frombuffer(where, np.int32, len(ids) + 1)[cut.offsets.to_numpy()]
        data = memoryview(data)
        for at, a, b in zip(np.flatnonzero(simple).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[at] = data[a:b].tobytes()
        return out


class _Remembered(dict):
    """Values by key, made once; of CACHED_WORDS keys at most, after which it begins anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[key] = made
        return made


@functools.cache
def encoder_of(file: str) -> Encoder:
    """One for each Python worker, which later tasks use again."""
    return Encoder(file)


def assign(lengths: list[int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Deal documents' remaining tokens to sequences of the given capacities.

    Returns the pieces (document, start, length, sequence, offset) and, when the capacities are used up, what is left
    over as (document, start, length). Equal costs go by document order, equal sequences by their number.
    """
    room = np.array(capacities, np.int64)
    cost = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    out, left, empty = [], [], 0
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, size = 0, lengths[doc]
        while size:
            if empty < len(room) and not used[empty] and room[empty] >= size:
                at, take = empty, size  # a sequence without tokens costs least
            elif (fits := room >= size).any():
                at, take = int(np.argmin(np.where(fits, cost, np.inf))), size
            elif len(room) and room.max() > 0:
                at = int(np.argmax(room))
                take = int(room[at])
            else:
                left.append((doc, start, size))
                break
            out.append((doc, start, take, at, int(used[at])))
            room[at] -= take
            used[at] += take
            cost[at] += LINEAR * take + QUADRATIC * take * take
            start += take
            size -= take
            while empty < len(room) and used[empty]:
                empty += 1
    return out, left


class _Packer:
    """Packs windows of pieces (doc_id, start, ids, tokens of the document) and carries on what does not fill a sequence."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.base, self.made = capacity, base, 0
        self.held: list[tuple] = []
        self.total = 0

    def add(self, doc_id: int | None, start: int, ids: bytes, tokens: int) -> None:
        step = 4 * self.capacity
        self.held += [(doc_id, start + a // 4, ids[a : a + step], tokens) for a in range(0, len(ids), step)]
        self.total += len(ids) // 4

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        many = -(-self.total // self.capacity) if last else self.total // self.capacity
        pieces, left = assign([len(h[2]) // 4 for h in self.held], [self.capacity] * many)
        rows = []
        for piece, a, size, at, offset in pieces:
            doc_id, start, ids, tokens = self.held[piece]
            rows.append((doc_id, start + a, size, ids[4 * a : 4 * (a + size)], tokens, self.base + self.made + at, offset))
        self.made += many
        self.held = [(self.held[p][0], self.held[p][1] + a, self.held[p][2][4 * a : 4 * (a + size)], self.held[p][3]) for p, a, size in left]
        self.total = sum(len(h[2]) // 4 for h in self.held)
        yield from _batches(rows)

    def tail(self) -> Iterator[pa.RecordBatch]:
        """What is left, without a sequence."""
        yield from _batches([(doc_id, start, len(ids) // 4, ids, tokens, None, None) for doc_id, start, ids, tokens in self.held])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _base(round_: int) -> int:
    """First sequence_id of the running task; no two tasks of all rounds share any of 2^33."""
    from pyspark import TaskContext

    return round_ << 57 | TaskContext.get().partitionId() << 33


def _pack(file: str, capacity: int, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(file), _Packer(capacity, _base(0))
        for batch in batches:
            for block in tb.blocks(batch, most=BLOCK_BYTES):
                for doc_id, ids in zip(block.column("doc_id").to_pylist(), encoder.encode_all(block.column("text")), strict=True):
                    packer.add(doc_id, 0, ids + end, len(ids) // 4 + 1)
                    if packer.total >= window:
                        yield from packer.flush()
        yield from packer.flush()
        yield from packer.tail()

    return run


def _pack_tails(capacity: int, window: int, round_: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, _base(round_))
        for batch in batches:
            for piece in batch.to_pylist():
                packer.add(piece["doc_id"], piece["start"], piece["ids"], piece["doc_tokens"])
                if packer.total >= window:
                    yield from packer.flush()
        yield from packer.flush(last)
        yield from packer.tail()

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, window: int = WINDOW_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document, with its ids; (sequence_id, offset) places it.

    tokenizer_file must be at that path on every executor.
    """
    small_batches(docs.sparkSession, 2048)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(text.mapInArrow(_pack(tokenizer_file, capacity, window, end_id), SCHEMA), "pieces")
    done = pieces.where("sequence_id IS NOT NULL")
    for round_ in range(1, 30):
        tails = pieces.where("sequence_id IS NULL")
        many = -(-(tails.agg(F.sum("length")).first()[0] or 0) // TAIL_TOKENS)
        if not many:
            break
        pieces = written(tails.repartition(many).mapInArrow(_pack_tails(capacity, window, round_, many == 1), SCHEMA), "tails")
        done = done.union(pieces.where("sequence_id IS NOT NULL"))
    return done
