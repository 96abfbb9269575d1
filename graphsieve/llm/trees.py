"""Quality rules over statistics of the text, with a gradient-boosted forest as the last one.

Trees are grown level by level on binned features by second-order gain of the logistic loss. On a feature with a
monotonic constraint a split is taken only if the child values keep the order, and the children's later values are bounded by
the middle between them. For scoring, all trees lie in flat node arrays (feature, threshold, left, right, value), and
a batch descends one level of every tree with a few array operations.

Defined cases: a null or empty text has no words and fails the base rules; a null doc_id stays null; repeated rows get equal
results; a very long text is read whole, as a block of its own; of splits with equal gain the first feature and bin is taken, and a
probability of just VERDICT passes; other columns are not looked at; an empty table gives no rows. Without labels of both kinds the forest is empty and passes
every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import stats
from graphsieve.llm import textblocks as tb
from graphsieve.llm.store import small_batches

TREES, DEPTH, BINS, RATE, RIDGE, LEAST_LEAF = 60, 4, 64, 0.2, 1.0, 20
#: A text's probability of quality never grows with these shares.
FALLING = ("symbol_share", "repeat_share", "dup_line_share", "doubled_share", "exclamation_share")
VERDICT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass
class Forest:
    """roots: each tree's first node. A leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        line = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[line, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


@dataclass
class _Nodes:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        at = len(self.value)
        for held, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, at), (self.right, at), (self.value, 0.0)):
            held.append(x)
        return at


def grow(x: np.ndarray, label: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest | None:
    """signs: 1 where the margin may only rise with a feature, -1 where it may only fall, else 0. None without labels of both kinds."""
    if len(np.unique(label)) < 2:
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    wide = BINS + 1
    rate = label.mean()
    bias = float(np.log(rate / (1 - rate)))
    margin = np.full(len(x), bias)
    nodes, roots = _Nodes(), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = label - p, p * (1 - p)
        root = nodes.add()
        roots.append(root)
        where = np.full(len(x), root)
        level = {root: (-np.inf, np.inf)}
        for _ in range(depth):
            after = {}
            for node, (low, high) in level.items():
                rows = np.flatnonzero(where == node)
                split = _best_split(bins[rows], g[rows], h[rows], signs, wide, low, high) if len(rows) >= 2 * LEAST_LEAF else None
                if split is None:
                    continue
                at, cut, a, b = split
                goes = bins[rows, at] <= cut
                nodes.feature[node], nodes.threshold[node] = at, edges[at][cut]
                nodes.left[node], nodes.right[node] = nodes.add(), nodes.add()
                where[rows] = np.where(goes, nodes.left[node], nodes.right[node])
                mid = (a + b) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(signs[at])]
                after[nodes.left[node]], after[nodes.right[node]] = bounds
                nodes.value[nodes.left[node]], nodes.value[nodes.right[node]] = a, b
            level = after
        value = np.array(nodes.value) * RATE
        margin += value[where]
    return Forest(np.array(nodes.feature), np.array(nodes.threshold), np.array(nodes.left), np.array(nodes.right), np.array(nodes.value) * RATE, np.array(roots), depth, bias)


def _best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, signs: np.ndarray, wide: int, low: float, high: float) -> tuple[int, int, float, float] | None:
    """Feature, greatest bin on the left, and both child values of the split of most gain."""
    n, many = bins.shape
    flat = (bins + np.arange(many) * wide).ravel()
    G, H, N = (np.cumsum(np.bincount(flat, np.repeat(v, many), many * wide).reshape(many, wide), axis=1) for v in (g, h, np.ones(n)))
    total_g, total_h = G[:, -1:], H[:, -1:]
    a = np.clip(G / (H + RIDGE), low, high)
    b = np.clip((total_g - G) / (total_h - H + RIDGE), low, high)

    def worth(value, g_sum, h_sum):
        return value * g_sum - 0.5 * value * value * (h_sum + RIDGE)

    whole = np.clip(total_g / (total_h + RIDGE), low, high)
    gain = worth(a, G, H) + worth(b, total_g - G, total_h - H) - worth(whole, total_g, total_h)
    gain[(N < LEAST_LEAF) | (n - N < LEAST_LEAF) | (signs[:, None] * (b - a) < 0)] = -1
    at, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(at), int(cut), float(a[at, cut]), float(b[at, cut])) if gain[at, cut] > 1e-6 else None


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Forest | None:
    """A forest for P(quality = 1), grown on at most `most` labelled documents that are not held out."""
    x, label = stats.training_sample(docs, labels, most=most)
    return grow(x, label, np.array([-1 if name in FALLING else 0 for name in stats.FEATURES]))


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def _judge(forest: Forest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                counts, x = stats.statistics(block.column("text"))
                n, repeated = counts["n_words"], counts["n_repeat_words"]
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
                p = forest.probability(x) if forest else np.ones(len(x))
                columns = [block.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in stats.COUNTS), pa.array(failed), pa.array(~failed & (p >= VERDICT)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def judged(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """Counts, base_failed, kept and the forest's probability for every row of docs, without a shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judge(forest), _SCHEMA)
