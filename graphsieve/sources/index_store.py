"""Screening indexes with their molecules in shards: ranges of mol_id, each of which can be read, screened and matched by itself.

A folder holds `postings` (the index), `packed` (what exact matching reads), both partitioned by shard_id, `words` (the dictionary of keys) and
`shards` (shard_id, first, last, molecules). Opening a store reads the last one only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.operators import screen
from graphsieve.operators.match import Pattern
from graphsieve.sources.tables import MOLECULES, Corpus

#: A folder and a row of `shards` for each; so many ids at most come to the driver.
MOST_SHARDS = 100_000


@dataclass
class IndexStore:
    postings: DataFrame
    packed: DataFrame
    words: DataFrame
    shards: DataFrame
    #: Of all molecules that words counts, the share that the opened shards hold.
    share: float = 1.0

    def candidates(self, patterns: list[tuple[int, Pattern]], families: tuple[str, ...] = screen.FAMILIES) -> DataFrame:
        """(query_id, mol_id); see screen.candidates."""
        return screen.candidates(self.postings, screen.requirement_table(self.postings.sparkSession, patterns), families, self.words, self.share)

    def candidate_counts(self, patterns: list[tuple[int, Pattern]]) -> DataFrame:
        """(query_id, n), the sum over all shards that were opened."""
        needs = screen.requirement_table(self.postings.sparkSession, patterns)
        found = self.candidates(patterns).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
        return needs.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("found", F.lit(0)).alias("n"))

    def hits(self, patterns: list[tuple[int, Pattern]]) -> DataFrame:
        """(query_id, mol_id) of exact matches, from the stored molecules."""
        return screen.exact(self.packed, self.candidates(patterns), patterns)


def _bounds(corpus: Corpus, shards: int) -> list[int]:
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}")
    if shards == 1:
        return []
    return sorted(set(corpus.packed.agg(F.percentile_approx("mol_id", [i / shards for i in range(1, shards)], max(10_000, 10 * shards))).first()[0] or []))


def write(corpus: Corpus, path: str, shards: int, codec: str = "zstd") -> IndexStore:
    """Index and molecules of a corpus in so many shards of about as many molecules. The driver gets one number a shard."""
    spark, bounds = corpus.packed.sparkSession, _bounds(corpus, shards)
    levels = max(1, len(bounds).bit_length())
    held = F.lit([*bounds, *[(1 << 63) - 1] * ((1 << levels) - 1 - len(bounds))]).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(levels))])
    shard = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(held, at + step - 1) < F.col("mol_id"), step).otherwise(0))
    tasks = max(spark.sparkContext.defaultParallelism, -(-corpus.packed.count() // MOLECULES))
    pieces = -(-tasks // (len(bounds) + 1))
    piece = (F.col("shard_id") * pieces + F.pmod(F.xxhash64("mol_id"), F.lit(pieces))).cast("int")
    packed = corpus.packed.withColumn("shard_id", shard).repartitionById(tasks, piece).sortWithinPartitions("shard_id", "mol_id")
    packed.write.mode("overwrite").option("compression", codec).partitionBy("shard_id").parquet(f"{path}/packed")
    packed = spark.read.parquet(f"{path}/packed")
    dealt = packed.repartitionById(tasks, piece)  # the index of a molecule is many rows, and these are sorted: as few molecules a task as before
    index = screen.features(Corpus(corpus.molecules, corpus.atoms, corpus.bonds, corpus.errors, dealt)).withColumn("shard_id", shard)
    index.sortWithinPartitions("shard_id", "family", "key", "mol_id").write.mode("overwrite").option("compression", codec).partitionBy("shard_id").parquet(f"{path}/postings")
    screen.dictionary(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/words")
    about = packed.groupBy("shard_id").agg(F.min("mol_id").alias("first"), F.max("mol_id").alias("last"), F.count(F.lit(1)).alias("molecules"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
    return read(spark, path)


def read(spark: SparkSession, path: str, shards: list[int] | None = None) -> IndexStore:
    """The store, or some of its shards; raises ValueError if shards overlap or one is asked for that is not there."""
    about = spark.read.parquet(f"{path}/shards")
    rows = about.collect()
    held = sorted((r.first, r.last, r.shard_id) for r in rows)
    for (_, last, a), (first, _, b) in zip(held, held[1:], strict=False):
        if first <= last:
            raise ValueError(f"shards {a} and {b} overlap")
    if shards is not None and (missing := set(shards) - {k for _, _, k in held}):
        raise ValueError(f"no shards {sorted(missing)}")

    def table(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        return df.drop("shard_id") if shards is None else df.where(F.col("shard_id").isin(shards)).drop("shard_id")

    opened = about if shards is None else about.where(F.col("shard_id").isin(shards))
    share = sum(r.molecules for r in rows if shards is None or r.shard_id in set(shards)) / max(1, sum(r.molecules for r in rows))
    return IndexStore(table("postings"), table("packed"), spark.read.parquet(f"{path}/words"), opened, share)
