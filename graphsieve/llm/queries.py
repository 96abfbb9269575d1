"""The queries of this subpackage, each over whole tables with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.llm import fingerprints, licenses, lines, minhash, mixing, packing, pairwise, passages, trees, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bound of the labelled documents that a model is fitted on.
LABELLED = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pairwise.scores(docs, pairwise.learn(docs, table(spark, sf_dir, "labels"), LABELLED))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shuffle_key")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"))


def op10_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return trees.judged(docs, trees.learn(docs, table(spark, sf_dir, "labels"), LABELLED))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pairwise_quality, op2_minhash, op3_warc, op4_licenses, op5_fingerprints, op6_mixing, op7_lines, op8_packing, op9_passages, op10_trees)
}

ORACLES: dict[str, str] = {"op2_minhash": minhash.SQL, "op3_warc": warc.SQL, "op6_mixing": mixing.SQL, "op7_lines": lines.SQL}
