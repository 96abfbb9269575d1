"""Quality scores learned from preferences: a Bradley-Terry model over statistics of the text.

P(i is preferred to j) = 1 / (1 + exp(-(s_i - s_j))) with s = w . x, so the loss is the logistic loss of feature
differences of preference pairs: a document labelled 1 is preferred to one labelled 0. The cut lies at the quantile of the training
scores below which the documents labelled 0 would fit; the published score is a logistic curve of s that is `CUT` there.

Defined cases: a null or empty text, or one of white space alone, scores 0; a very long text is read whole, as a block of its own; a
null doc_id stays null, and is not held out; repeated rows get the same score each; a score of just 0.3 is predicted 1; of repeated
labels the greatest counts, and of labelled documents with equal hashes the least doc_id comes first into the sample; other columns are not looked at; an empty table gives no rows. Without labels of both
kinds there is nothing to prefer, and every text with words scores 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import stats
from graphsieve.llm import textblocks as tb
from graphsieve.llm.store import small_batches

CUT = 0.3
PAIRS = 200_000
_STEPS, _RIDGE = 25, 1e-3


@dataclass
class Ranking:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.cut) * self.slope + shift, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking | None:
    """Newton steps on the ridged logistic loss of `pairs` feature differences; None without labels of both kinds."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    spread = x.std(axis=0)
    out = Ranking(x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * x.shape[1]), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    size = min(pairs, 20 * len(x))
    z = out.inputs(x)
    d = z[rng.choice(good, size)] - z[rng.choice(bad, size)]
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ out.weights, -30, 30)))
        slope = d.T @ (1 - p) / size - _RIDGE * out.weights
        bend = (d * (p * (1 - p))[:, None]).T @ d / size + _RIDGE * np.eye(d.shape[1])
        step = np.linalg.solve(bend, slope)
        out.weights = out.weights + step
        if np.abs(step).max() < 1e-6:
            break
    s = out.strength(x)
    out.cut = float(np.quantile(s, len(bad) / len(x)))
    return out


def _scores(model: Ranking | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                counts, x = stats.statistics(block.column("text"))
                score = model.score(x) if model else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.where(counts["n_words"] > 0, score, 0.0))], ["doc_id", "score"])

    return run


def _kept(model: Ranking | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                counts, x = stats.statistics(block.column("text"))
                score = model.score(x) if model else np.ones(len(x))
                yield block.filter(pa.array((counts["n_words"] > 0) & (score >= least)))

    return run


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Ranking | None:
    """A ranking fitted on at most `most` labelled documents that are not held out (see stats.training_sample)."""
    return fit(*stats.training_sample(docs, labels, most=most))


def scores(docs: DataFrame, model: Ranking | None, least: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, without a shuffle."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = text.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", stats.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Ranking | None, least: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they were, that score `least` or more."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_kept(model, least), docs.schema)
