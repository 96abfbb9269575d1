"""Patterns against a stream of molecules: a stateless map with a fixed set of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.functions.sql import function


def matched(molecules: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """(mol_id, smiles, query_id) of the pairs that match; molecules may be a stream."""
    known = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(s).alias("smarts")) for i, s in patterns])
    pairs = molecules.select("mol_id", "smiles", F.explode(known).alias("p")).select("mol_id", "smiles", "p.query_id", "p.smarts")
    return pairs.where(function("smiles_match")("smiles", "smarts")).select("mol_id", "smiles", "query_id")
