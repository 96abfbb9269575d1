"""Words, lines and shingles of many texts at once, as numpy arrays over the bytes of an Arrow column.

All functions take whole texts. Texts are cut into blocks of rows only to bound memory; a single long text is a block
of its own, and its words are hashed in slices, so that the working memory stays at a few bytes per byte of text.
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 1 << 19
_POSITIONS = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of words split by white space, of runs of lower-case letters, digits and non-ASCII, and of lines.
SPACED = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = _byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LINES = ~_byte_class((0x0A, 0x0A))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finalizer of the SplitMix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1000, 1000 + _POSITIONS, dtype=np.uint64)) | np.uint64(1)
_ORDER = mix(np.arange(9000, 9064, dtype=np.uint64)) | np.uint64(1)


class Texts(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """The UTF-8 bytes of a string column, without copying them where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of rows whose texts together take `most` bytes, or a single longer text. After the last one, memory that is free goes back to the system."""
    sizes = np.diff(texts_of(batch.column(column)).offsets)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)
    _give_back()


def _give_back() -> None:
    """Workers live on between stages, and what they keep would add up with the Java heap's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Words(NamedTuple):
    """starts, ends: byte positions of each word; first: each row's first word, and after the last row the number of words."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: Texts, member: np.ndarray = SPACED) -> Words:
    """Longest runs of bytes in `member`; none goes from one row into the next."""
    data, offsets = texts
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def hash_words(data: np.ndarray, words: Words, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words' bytes; equal words have equal hashes wherever they stand."""
    lengths = words.ends - words.starts
    out = np.empty(len(lengths), np.uint64)
    reach = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + SLICE_BYTES, "right")))
        size = lengths[a:b]
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        got = data[within + np.repeat(words.starts[a:b], size)]
        part = _BYTE[LOWER[got] if lower else got] * _PLACE[within & (_POSITIONS - 1)]
        if len(size) and size.max() > _POSITIONS:
            part *= (within // _POSITIONS * 2 + 1).astype(np.uint64)
        out[a:b] = np.add.reduceat(part, begin)
        a = b
    return mix(out ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def shingles_of(hashes: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every `width` consecutive words of a row, and each row's first shingle.

    A row with fewer words, but one at least, has its whole word sequence as its one shingle.
    """
    counts = words.counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(int(first[-1])) - np.repeat(first[:-1], made) + np.repeat(words.first[:-1], made)
    short = np.repeat(counts < width, made)
    size = np.repeat(np.minimum(counts, width), made)
    out = size.astype(np.uint64)
    for j in range(width):
        there = hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] * _ORDER[j] if len(hashes) else out
        out += np.where(short & (j >= size), np.uint64(0), there)
    return mix(out), first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values, sorted and without repeats, and each row's first one."""
    parts, sizes = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(values[a:b])
        if b - a > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes.append(len(own))
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of `flags` over each row's stretch."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
