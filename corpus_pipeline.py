"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept: documents that the classifier rejects go, boilerplate lines are cut out,
one document of each near-duplicate group stays, sources are mixed to their target weights, and what is left is packed. All but
the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.llm import lines, minhash, mixing, packing, pairwise, queries
from graphsieve.llm.store import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score 0.3 or more, as they are.

    Defined cases: null and empty texts and such of white space alone go; without labels of both kinds all others stay; a null doc_id, null columns and
    repeated rows are judged by their text; an empty table gives no rows.
    """
    model = pairwise.learn(docs, queries.table(spark, sf_dir, "labels"), queries.LABELLED)
    return pairwise.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, without the lines that stand on many sources; n_chars is counted anew where a line went.

    Defined cases: null and empty texts, and texts that are boilerplate alone, stay as they are; a null source is no site; a null doc_id and repeated rows
    stay; an empty table gives no rows.
    """
    cut = lines.without_boilerplate(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row that comes first by doc_id and text, as it is.

    Defined cases: null and empty texts are no duplicates of anything and stay, as do rows with a null doc_id; rows that repeat a doc_id are compared by their
    own texts, and equal ones leave one; an empty table gives no rows.
    """
    return minhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs as often as their source's rate and the hash of their doc_id say, in random order.

    Defined cases: a null source is the empty one; a null doc_id draws by its text; null texts are repeated as they are; repeated rows draw alike; an empty
    table gives no rows.
    """
    return mixing.mix(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of docs in sequences of 2,048 tokens.

    Defined cases: a null or empty text is the end token alone; a null doc_id stays null; repeated rows are packed one by one; an empty table gives no rows.
    """
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the classifier, the signatures and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on what its predecessor returned, which is stored until the last one has packed it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as held:
        for name, stage in STAGES[:-1]:
            docs = held.written(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
