"""Connected components of a graph given by its edges, by local union-find and alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.store import Scratch, written

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch of edges: every vertex with the least vertex that the batch links it to."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(names)))
        for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
        for x in range(len(parent)):  # a parent is never greater than its child
            parent[x] = parent[parent[x]]
        child = np.arange(len(names))
        parents = np.asarray(parent)
        keep = parents != child
        yield pa.RecordBatch.from_arrays([pa.array(names[parents[keep]]), pa.array(names[keep])], ["a", "b"])


#: So many edges at most, 16 bytes each, are joined in one task; more are contracted by shuffles.
SMALL = 1_000_000


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _forest(iter(pa.Table.from_batches(list(batches), _EDGES).combine_chunks().to_batches()))


def _toward_least(edges: DataFrame, large: bool, held: Scratch) -> DataFrame:
    """Large star: each vertex points its greater neighbours to its least one. Small star: its smaller neighbours and itself."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.union(turned) if large else turned
    # Stored before it is joined, so that Spark can split the partition of a vertex with very many neighbours in the join.
    least = held.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = met.where("b <> m").select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return held.written(out.where("a <> b").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the least vertex reachable from v.

    Self-loops, repeated and reversed edges do no harm; a null endpoint drops the edge. Vertices without edges have no row.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    with Scratch(edges.sparkSession) as held:
        now = held.written(edges.mapInArrow(_forest, "a long, b long").distinct(), "forest")
        if now.count() <= SMALL:
            now = now.coalesce(1).mapInArrow(_whole_forest, "a long, b long")
        else:
            state = None
            while True:
                seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
                if tuple(seen) == state:
                    break
                state = tuple(seen)
                now = _toward_least(_toward_least(now, True, held), False, held)
        now = written(now, "components")
    return now.select(F.col("b").alias("v"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
