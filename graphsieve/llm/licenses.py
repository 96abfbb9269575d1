"""Licence scan by a positional index of rare words.

The texts of usual licences, their headers and the sentences that name them are kept as word sequences (notices.py). The
inverse document frequency of their words is counted over all documents; each notice is indexed by its rarest words, with their
places, ANCHORS of them and one more for every SPACING words. An occurrence in a text of such a word proposes where a notice
would begin; proposals on which several rare words agree, but for SLACK places, are verified: every key phrase of the notice
must stand in the window, and LEAST of the notice's words. Next to these labels the scan reports exact places of base phrases.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; a very long text is read whole, as a block
of its own; of words of equal frequency the alphabetically first is the rarer one; a null doc_id stays null; repeated
rows get equal results; other columns are not looked at; an empty table gives no rows. The score is 1 where a base phrase
stands, else the greatest share of words found of an accepted notice, else 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import notices
from graphsieve.llm import textblocks as tb
from graphsieve.llm.store import small_batches

#: Base phrases with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

ANCHORS, SPACING, AGREE, SLACK, LEAST = 4, 20, 2, 2, 0.7

#: Notices as (label, words, key phrases).
NOTICES = tuple((label, re.findall("[a-z0-9]+", text.lower()), tuple(tuple(k.split()) for k in keys)) for label, text, keys in (*notices.NAMED, *notices.FULL))


def _hash(words: list[str]) -> np.ndarray:
    texts = tb.texts_of(pa.array(words, pa.string()))
    found = tb.words_of(texts, tb.ALNUM)
    return tb.hash_words(texts.data, found)


VOCABULARY = sorted({w for phrase, _ in BASE for w in phrase.split()} | {w for _, notice, _ in NOTICES for w in notice})


@dataclass
class Lexicon:
    """order: the vocabulary's hashes, sorted; number: the vocabulary number of each."""

    order: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Lexicon:
        hashes = _hash(words)
        number = np.argsort(hashes)
        return cls(hashes[number], number)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers, -1 for other words."""
        at = np.minimum(np.searchsorted(self.order, hashes), len(self.order) - 1)
        return np.where(self.order[at] == hashes, self.number[at], -1)


def _read(column: pa.Array) -> tuple[np.ndarray, tb.Words, np.ndarray]:
    texts = tb.texts_of(column)
    data = tb.LOWER[texts.data]
    words = tb.words_of(tb.Texts(data, texts.offsets), tb.ALNUM)
    return data, words, tb.hash_words(data, words)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon.of(VOCABULARY)
    found = np.zeros(len(VOCABULARY) + 1, np.int64)
    for batch in batches:
        for block in tb.blocks(batch):
            _, words, hashes = _read(block.column("text"))
            numbers = lexicon.numbers(hashes)
            at = np.flatnonzero(numbers >= 0)
            pairs = np.unique(words.row[at] * len(VOCABULARY) + numbers[at])
            found[:-1] += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
            found[-1] += block.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["word", "n"])


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each word of VOCABULARY stands, and how many documents there are; the driver gets one row a word."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return {w: counts.get(i, 0) for i, w in enumerate(VOCABULARY)}, counts.get(len(VOCABULARY), 0)


class Scanner:
    def __init__(self, frequency: dict[str, int], documents: int):
        self.lexicon = Lexicon.of(VOCABULARY)
        idf = {w: math.log((documents + 1) / (frequency[w] + 1)) for w in VOCABULARY}
        self.notices = NOTICES
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words, _) in enumerate(self.notices):
            for w in sorted(set(words), key=lambda w: (-idf[w], w))[: ANCHORS + len(words) // SPACING]:
                self.postings[w] += [(i, q) for q, x in enumerate(words) if x == w]
        self.anchor = np.array([w in self.postings for w in VOCABULARY])
        self.base = [(phrase.split(), label, _hash(phrase.split())) for phrase, label in BASE]

    def base_places(self, data: np.ndarray, words: tb.Words, hashes: np.ndarray) -> list[tuple[int, int, str]]:
        """(row, place of the first word in its row, label) of every base phrase."""
        row, out = words.row, []
        for phrase, label, wanted in self.base:
            at = np.flatnonzero(hashes == wanted[0])
            at = at[at + len(phrase) <= len(hashes)]
            for j in range(1, len(phrase)):
                at = at[(hashes[at + j] == wanted[j]) & (row[at + j] == row[at])]
            for i in at.tolist():
                if all(data[words.starts[i + j] : words.ends[i + j]].tobytes() == w.encode() for j, w in enumerate(phrase)):
                    out.append((int(row[i]), i - int(words.first[row[i]]), label))
        return out

    def notices_in(self, text: list[str]) -> dict[str, float]:
        """Labels of accepted notices with their best share of words found; of notices that begin at one place, the one with most words found counts."""
        votes: dict[tuple[int, int], set[str]] = defaultdict(set)
        for p, word in enumerate(text):
            for notice, q in self.postings.get(word, ()):
                votes[notice, p - q].add(word)
        fits: list[tuple[int, int, str, float]] = []
        for notice, start in votes:
            label, words, keys = self.notices[notice]
            agreed = set().union(*(votes.get((notice, start + d), set()) for d in range(-SLACK, SLACK + 1)))
            if len(agreed) < AGREE:
                continue
            window = text[max(0, start - SLACK) : start + len(words) + SLACK]
            found = sum((Counter(words) & Counter(window)).values())
            if found >= LEAST * len(words) and all(any(tuple(window[i : i + len(k)]) == k for i in range(len(window) - len(k) + 1)) for k in keys):
                fits.append((start, found, label, found / len(words)))
        out: dict[str, float] = {}
        for start, found, label, share in fits:
            if not any(more > found and abs(at - start) <= SLACK for at, more, _, _ in fits):
                out[label] = max(out.get(label, 0.0), share)
        return out

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                data, words, hashes = _read(block.column("text"))
                rows = block.num_rows
                places, marked = defaultdict(list), defaultdict(dict)
                for row, place, label in self.base_places(data, words, hashes):
                    places[row].append((place, label))
                numbers = self.lexicon.numbers(hashes)
                hits = np.flatnonzero(self.anchor[numbers] & (numbers >= 0))
                reach = max(len(w) for _, w, _ in self.notices) + SLACK
                for row, a, b in _stretches(hits, words, reach):
                    text = [VOCABULARY[k] if k >= 0 else "" for k in numbers[a:b].tolist()]
                    for label, share in self.notices_in(text).items():
                        marked[row][label] = max(marked[row].get(label, 0.0), share)
                base = [sorted({label for _, label in places[r]}) if r in places else [] for r in range(rows)]
                every = [sorted({*base[r], *marked[r]}) if r in marked else base[r] for r in range(rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array([len(places[r]) if r in places else 0 for r in range(rows)], pa.int64()),
                        pa.array([min(places[r])[0] if r in places else None for r in range(rows)], pa.int64()), pa.array([max(places[r])[0] if r in places else None for r in range(rows)], pa.int64()),
                        pa.array([",".join(x) for x in base]), pa.array([",".join(x) for x in every]),
                        pa.array([1.0 if base[r] else max(marked[r].values(), default=0.0) if r in marked else 0.0 for r in range(rows)], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )


def _stretches(hits: np.ndarray, words: tb.Words, reach: int) -> Iterator[tuple[int, int, int]]:
    """(row, first word, end) around rare words, joined where they are within reach of one another in a row."""
    if not len(hits):
        return
    row = np.searchsorted(words.first, hits, "right") - 1
    cut = np.flatnonzero((np.diff(hits) > 2 * reach) | (np.diff(row) > 0)) + 1
    for part in np.split(np.arange(len(hits)), cut):
        if len(part) >= AGREE:
            r = int(row[part[0]])
            yield r, max(int(words.first[r]), int(hits[part[0]]) - reach), min(int(words.first[r + 1]), int(hits[part[-1]]) + reach)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """Places of base phrases and labels of every row of docs: one pass for word frequencies, one for the scan, no shuffle of texts."""
    small_batches(docs.sparkSession)
    scanner = Scanner(*document_frequencies(docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scanner.scan, _SCHEMA)
