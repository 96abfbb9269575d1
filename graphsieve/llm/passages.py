"""Removal of repeated passages: sliding spans of consecutive sentences.

A sentence ends after a word that ends in . ! or ?, before closing quotes and brackets, and at the text's end. Every run of SENTENCES
consecutive sentences that has WORDS words or more is a span. Spans are hashed over their words (A-Z lower-cased), spans with equal hashes
are joined globally, and every sentence goes that lies in a span which is not the first of its kind, by doc_id and place.

Sentences of many words, and those that a passage shares with the words before and after it, make no common span. So that any run of
SHARED words holds one wherever it is copied to, in each run of SHARED words in which no span lies whole, after a sentence end of
the run itself, the WORDS words in turn with the least hash are a span too (winnowing). At the edges of these, sentences are cut
into parts. So every SHARED words of a passage hold a span that goes, at each edge as many as SHARED - WORDS words may stay, and what
is shorter than WORDS words is never removed: a few boilerplate lines or a licence notice make no passage.

Defined cases: a null text stays null; a text whose words do not fill a span stays as it is; a very long text is read whole, as a block
of its own; a null doc_id is neither compared nor cut; rows that repeat a doc_id count as one document, so that equal ones are cut
alike; of spans in one document the first place counts; other columns are not looked at; an empty table gives no rows. White space
around kept sentences stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import textblocks as tb
from graphsieve.llm.store import small_batches, written

SENTENCES, WORDS = 4, 32
#: Words of a run that is never missed whole.
SHARED = 50
_SLICE = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_CLOSERS = np.isin(np.arange(256), np.frombuffer(b"\"')]", np.uint8))


class Sentences:
    """first, end: first word, and the word after the last one, of each sentence or part of one, over all rows; of_row: each row's first part."""

    def __init__(self, column: pa.Array):
        self.texts = texts = tb.texts_of(column)
        self.words = words = tb.words_of(texts)
        self.hashes = tb.hash_words(texts.data, words, lower=True)
        n = len(self.hashes)
        last = words.ends - 1
        last = np.where(_CLOSERS[texts.data[last]] & (last > words.starts), last - 1, last) if n else last
        marked = _ENDS[texts.data[last]] if n else np.zeros(0, bool)
        row_first, row_last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        row_first[words.first[:-1]] = row_last[words.first[1:]] = True
        ends = np.flatnonzero(marked | row_last[1:]) + 1
        self._sum_words()
        begins, row_end = np.concatenate([[0], ends]), np.append(words.first, n)
        a, b = begins[: max(len(ends) - SENTENCES + 1, 0)], ends[SENTENCES - 1 :]
        fits = (b - a >= WORDS) & (b <= row_end[np.searchsorted(words.first, a, "right")])
        a, b = a[fits], b[fits]
        free = ~row_first[a] & marked[b - 1]
        seeds = self._seeds(a[free], b[free])
        self._begins, self._ends = np.concatenate([a, seeds]), np.concatenate([b, seeds + WORDS])
        self.end = np.unique(np.concatenate([ends, seeds[~row_first[seeds]], seeds + WORDS]))
        self.first = np.concatenate([[0], self.end[:-1]]) if n else self.end
        self.of_row = np.searchsorted(self.first, words.first)

    def _sum_words(self) -> None:
        n = len(self.hashes)
        powers = np.full(n, _BASE, np.uint64)
        self._inverse = inverse = np.full(n, _INVERSE, np.uint64)
        if n:
            powers[0] = inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(inverse, out=inverse)
        self._total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers, dtype=np.uint64)])

    def _run_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tb.mix((self._total[b] - self._total[a]) * self._inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if len(a) else np.zeros(0, np.uint64)

    def _seeds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """First words of the spans by words alone; a, b: the spans of sentences that do not depend on what stands around them."""
        row_end = np.repeat(self.words.first[1:], self.words.counts)
        run = np.arange(len(row_end))
        run = run[run + SHARED <= row_end]
        run = run[np.append(b, len(row_end) + SHARED)[np.searchsorted(a, run + 1, "left")] > run + SHARED]
        at = np.arange(max(len(self.hashes) - WORDS + 1, 0))
        hashes, inside = self._run_hashes(at, at + WORDS) if len(run) else at, np.arange(SHARED - WORDS + 1)
        found = [part + hashes[part[:, None] + inside].argmin(axis=1) for part in (run[i : i + _SLICE] for i in range(0, len(run), _SLICE))]
        return np.unique(np.concatenate(found)) if found else run

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last part of every span, in order."""
        order = np.lexsort((self._ends, self._begins))
        a, b = self._begins[order], self._ends[order]
        new = np.concatenate([[True], (np.diff(a) > 0) | (np.diff(b) > 0)])[: len(a)]
        return np.searchsorted(self.first, a[new]), np.searchsorted(self.end, b[new])

    def span_hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self._run_hashes(self.first[first], self.end[last])

    def row_of(self, sentence: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.of_row, sentence, "right") - 1


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch):
            s = Sentences(block.column("text"))
            first, last = s.spans()
            row = s.row_of(first)
            h = s.span_hashes(first, last)
            fresh = np.zeros(len(h), bool)
            fresh[np.unique(tb.mix(h + row.astype(np.uint64) * np.uint64(_BASE)), return_index=True)[1]] = True
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            base = s.of_row[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row].astype(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(fresh)], ["h", "doc_id", "first", "last", "fresh"])


_OUT = "doc_id long, text string, n_removed long, spans array<struct<start:long,end:long>>"
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch):
            ids, bad = block.column("doc_id"), block.column("bad")
            texts, removed, spans = [], [], []
            for i in range(block.num_rows):
                text, cuts, n = block.column("text")[i].as_py(), [], 0
                if bad[i].is_valid:
                    text, cuts, n = _without(block.column("text").slice(i, 1), bad[i].values)
                texts.append(text)
                removed.append(n)
                spans.append(cuts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, _SPAN_LIST)], ["doc_id", "text", "n_removed", "spans"])


def _without(column: pa.Array, bad: pa.StructArray) -> tuple[str, list[dict], int]:
    """The text without the sentences in the given spans, the cut stretches in code points, and the number of sentences and parts."""
    s = Sentences(column)
    first, last, h = (bad.field(f).to_numpy(zero_copy_only=False) for f in ("first", "last", "h"))
    there = last < len(s.end)
    first, last, h = first[there], last[there], h[there]
    same = s.span_hashes(first, last).view(np.int64) == h  # of another row with this doc_id otherwise
    out = np.zeros(len(s.end) + 1, np.int64)
    np.add.at(out, first[same], 1)
    np.add.at(out, last[same] + 1, -1)
    gone = np.cumsum(out)[:-1] > 0
    data = s.texts.data
    edge = np.concatenate([s.words.starts[s.first], [len(data)]])
    flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    keep, cuts, at = [], [], 0
    for a, b in zip(edge[flips[::2]].tolist(), edge[flips[1::2]].tolist(), strict=True):
        keep.append(data[at:a])
        cuts.append((a, b))
        at = b
    keep.append(data[at:])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return b"".join(x.tobytes() for x in keep).decode(), [{"start": int(points[a]), "end": int(points[b])} for a, b in cuts], int(gone.sum())


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, the cut text, n_removed sentences and parts of them, and the removed spans of the old text in code points, for every row of docs."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = written(text.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_spans, "h long, doc_id long, first int, last int, fresh boolean"), "spans")
    # Stored before it is joined, so that Spark can split the partitions of very frequent spans in the join.
    repeated = written(spans.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "owner"), "repeated")
    later = spans.join(repeated, "h").where("doc_id > owner OR NOT fresh")
    bad = later.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "h")).alias("bad"))
    return text.join(bad, "doc_id", "left").mapInArrow(_cut, _OUT)
