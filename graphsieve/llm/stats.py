"""Statistics of whole texts: exact counts for quality rules, and the shares that learned models read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import textblocks as tb
from graphsieve.llm.store import small_batches

WINDOW = 5
#: The symbols that count as such in rules.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(0x61, 0x7B)) | (np.arange(256) >= 0xC0)
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_CHARACTER = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "upper_share", "punctuation_share", "digit_share", "repeat_share", "dup_line_share",
    "known_word_share", "doubled_share", "short_word_share", "long_word_share", "sentence_ends", "line_words", "exclamation_share",
)


def _marked(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return tb.mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """COUNTS of each text, and a matrix of FEATURES; a null text counts as an empty one."""
    texts = tb.texts_of(column)
    data, offsets = texts
    rows = texts.rows
    words = tb.words_of(texts)
    row, n = words.row, words.counts
    hashes = tb.hash_words(data, words)
    size = np.concatenate([[0], np.cumsum(_CHARACTER[data], dtype=np.int64)])
    length = size[words.ends] - size[words.starts]
    chars = size[offsets[1:]] - size[offsets[:-1]]

    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        at = np.flatnonzero(row[: 1 - WINDOW] == row[WINDOW - 1 :])
        window = _marked(sum((hashes[at + j] * tb._ORDER[j] for j in range(WINDOW)), np.uint64(0)), row[at])
        order = np.sort(window)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            place = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            hit = at[twice[place] == window]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
    repeated = tb.per_row(np.cumsum(covered)[:-1] > 0, words.first)

    lines = tb.words_of(texts, tb.LINES)
    inside = np.concatenate([[0], np.cumsum(tb.SPACED[data], dtype=np.int64)])
    full = inside[lines.ends] > inside[lines.starts]
    line_row = lines.row[full]
    marked = _marked(tb.hash_words(data, lines)[full], line_row)
    n_lines = np.bincount(line_row, minlength=rows)
    dup_lines = n_lines - np.bincount(line_row[np.unique(marked, return_index=True)[1]], minlength=rows)

    def count(member: np.ndarray) -> np.ndarray:
        return tb.per_row(member[data], offsets)

    symbols = count(SYMBOLS)
    known = n - np.bincount(row[np.unique(_marked(hashes, row), return_index=True)[1]], minlength=rows)
    doubled = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    ended = np.bincount(row[_ENDS[data[words.ends - 1]]] if len(row) else row, minlength=rows)
    word_chars = tb.per_row(length, words.first)
    counts = {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}
    exclaimed = tb.per_row(data == 0x21, offsets)
    features = np.stack([
        np.log1p(n), _over(word_chars, n), _over(symbols, chars), _over(count(_UPPER), count(_LETTER)), _over(count(_PUNCTUATION), chars), _over(count(_DIGIT), chars),
        _over(repeated, n), _over(dup_lines, n_lines), _over(known, n), _over(doubled, n), _over(tb.per_row(length <= 1, words.first), n), _over(tb.per_row(length > 12, words.first), n),
        _over(ended, n), np.log1p(_over(n, n_lines)), _over(exclaimed, chars),
    ], axis=1)
    return counts, features


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch):
            _, x = statistics(block.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), lists], ["doc_id", "label", "x"])


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text is divisible by 5; false for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents that are not held out.

    The sample, the least `most` doc_id by a hash, bounds what the driver gets (`most` rows of FEATURES) and what is
    broadcast (`most` pairs of numbers). Null labels are left out; of repeated labels the greatest counts, of repeated
    documents the least features.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_labelled, "doc_id long, label int, x array<double>")
    rows = sorted(found.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).collect(), key=lambda r: r.doc_id)
    return np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows], int)
