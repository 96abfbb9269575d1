"""Functions over SMILES and SMARTS texts as columns, and their names in SQL.

All take a null for a null, and answer null for a text that is no molecule or no pattern. Each batch parses a distinct text once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphsieve.chem.perception import prepare
from graphsieve.chem.smiles import SmilesError
from graphsieve.plans.kernel import Matcher
from graphsieve.smarts import canonical, edit, query


@functools.lru_cache(10_000)
def _matcher(smarts: str) -> Matcher | None:
    try:
        return Matcher.of(smarts)
    except ValueError:
        return None


@functools.lru_cache(10_000)
def _molecule(smiles: str):
    try:
        return prepare(smiles) if smiles.strip() else None
    except SmilesError:
        return None


_PATTERN = {
    "smarts_canonical": (canonical.canonical, "string"),
    "smarts_labeling": (canonical.canonical_labeling, "array<int>"),
    "smarts_text": (query.to_smarts, "string"),
    "smarts_atom_count": (lambda q: len(q.atoms), "long"),
    "smarts_bond_count": (lambda q: len(q.bonds), "long"),
    "smarts_component_count": (lambda q: q.components, "long"),
    "smarts_recursive_depth": (edit.recursive_depth, "long"),
}
_PAIR = {
    "smiles_match": (lambda p, m: p.matches(m), "boolean"),
    "smiles_match_count": (lambda p, m: p.count(m), "long"),
    "smiles_match_coverage": (lambda p, m: p.outcome(m).coverage, "double"),
}
_TEXT = {"smarts_valid": (lambda x: query.error_code(x) is None, "boolean"), "smarts_error_code": (query.error_code, "string")}
NAMES = (*_TEXT, *_PATTERN, *_PAIR)


@functools.lru_cache(100_000)
def of_pattern(name: str, smarts: str):
    try:
        return _PATTERN[name][0](query.parse(smarts))
    except ValueError:
        return None


def of_pair(name: str, smiles: str | None, smarts: str | None):
    if smiles is None or smarts is None:
        return None
    molecule, pattern = _molecule(smiles), _matcher(smarts)
    return None if molecule is None or pattern is None else _PAIR[name][0](pattern, molecule)


@functools.cache
def function(name: str) -> Callable:
    """The function of that name, which takes one column of patterns, or one of molecules and one of patterns."""
    if name in _PAIR:

        def run(smiles: pd.Series, smarts: pd.Series) -> pd.Series:
            return pd.Series([of_pair(name, a, b) for a, b in zip(smiles, smarts, strict=True)], dtype=object)

        return F.pandas_udf(run, _PAIR[name][1])

    def one(smarts: pd.Series) -> pd.Series:
        call = _TEXT[name][0] if name in _TEXT else functools.partial(of_pattern, name)
        return pd.Series([None if x is None else call(x) for x in smarts], dtype=object)

    return F.pandas_udf(one, (_TEXT | _PATTERN)[name][1])


class Embeddings:
    """Table function: a row for each set of atoms on which the pattern lies in the molecule; none for a text that is neither."""

    def eval(self, smiles: str, smarts: str):
        molecule, pattern = (None, None) if smiles is None or smarts is None else (_molecule(smiles), _matcher(smarts))
        if molecule is not None and pattern is not None:
            for place, to in enumerate(pattern.unique(molecule)):
                yield place, to


def register(spark: SparkSession) -> None:
    """Makes every function known to SQL by its name, and smiles_embeddings(smiles, smarts) as a table function."""
    for name in NAMES:
        spark.udf.register(name, function(name))
    spark.udtf.register("smiles_embeddings", F.udtf(Embeddings, returnType="place int, atoms array<int>"))


def smiles_match(smiles: str | Column, smarts: str | Column) -> Column:
    return function("smiles_match")(smiles, smarts)
