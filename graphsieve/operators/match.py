"""Pattern queries over a corpus: existence, counts, embeddings and coverage.

There are three ways to the same answers. `by_batch` takes packed molecules as they are stored and matches many patterns with
arrays, without a shuffle. `plans.joins` lowers one pattern to joins over atoms and bonds tables, where the corpus has no packed
rows or `joined` is asked for. `by_kernel` takes texts, and a deadline or an interrupt for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.chem.perception import prepare
from graphsieve.chem.smiles import SmilesError
from graphsieve.plans import joins
from graphsieve.plans.columnar import Batch, Program
from graphsieve.plans.kernel import Exceeded, Matcher, until
from graphsieve.smarts.query import Query, parse, to_smarts
from graphsieve.sources.tables import TEXTS, Corpus
from graphsieve.workspace import spread

Pattern = str | Query

KERNEL = "smiles string, query_id long, matched boolean, n long, coverage double, embeddings array<array<int>>, exceeded boolean"
_ARROW = pa.schema([("smiles", pa.string()), ("query_id", pa.int64()), ("matched", pa.bool_()), ("n", pa.int64()), ("coverage", pa.float64()), ("embeddings", pa.list_(pa.list_(pa.int32()))), ("exceeded", pa.bool_())])


def _answers(patterns: list[tuple[int, str]], seconds: float | None, shape: str, interrupt: Callable[[], bool] | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [(i, Matcher.of(s)) for i, s in patterns]
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                try:
                    m = prepare(text) if (text or "").strip() else None
                except SmilesError:
                    m = None
                if m is None:
                    continue
                for i, matcher in matchers:
                    late = until(seconds) if seconds is not None else None
                    poll = (lambda late=late: interrupt() or late is not None and late()) if interrupt else late
                    row = {"smiles": text, "query_id": i, "exceeded": False}
                    try:
                        if shape == "exists":
                            row["matched"] = matcher.matches(m, poll)
                        elif shape == "coverage":
                            found = matcher.outcome(m, poll)
                            row |= {"matched": found.matched, "coverage": found.coverage}
                        else:
                            found = matcher.unique(m, poll)
                            row |= {"matched": bool(found), "n": len(found), "embeddings": found if shape == "embeddings" else None}
                    except Exceeded:
                        row = {"smiles": text, "query_id": i, "exceeded": True}
                    rows.append(row)
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def _texts(patterns: list[tuple[int, Pattern]]) -> list[tuple[int, str]]:
    return [(i, p if isinstance(p, str) else to_smarts(p)) for i, p in patterns]


def by_kernel(molecules: DataFrame, patterns: list[tuple[int, Pattern]], shape: str = "count", seconds: float | None = None, interrupt: Callable[[], bool] | None = None) -> DataFrame:
    """(mol_id, query_id, matched, n, coverage, embeddings, exceeded) of every molecule with every pattern; each distinct text is matched once.

    shape: exists, count, embeddings or coverage; other columns than it asks for are null. With `seconds`, a pair that takes longer is exceeded, and
    its answer null; so is one during which `interrupt`, which the executors call again and again, is true.
    """
    texts = spread(molecules.select("smiles").where("smiles IS NOT NULL").distinct(), molecules.count(), TEXTS)
    found = texts.mapInArrow(_answers(_texts(patterns), seconds, shape, interrupt), KERNEL)
    return molecules.select("mol_id", "smiles").join(found, "smiles").drop("smiles")


#: Columns of by_batch after mol_id and query_id, by shape.
SHAPES = {"exists": "", "count": ", n long", "embeddings": ", embeddings array<array<int>>", "coverage": ", matched boolean, coverage double"}


def _nested(mol: np.ndarray, rows: np.ndarray, size: int) -> pa.Array:
    """Of each molecule the list of its rows, each a list."""
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(mol, np.arange(size + 1)), pa.int32()), inner)


def _answer(program: Program, batch: Batch, shape: str, only: np.ndarray | None) -> tuple[np.ndarray, list[pa.Array]]:
    """Numbers of the molecules that have an answer, and its columns."""
    if shape == "exists":
        return np.flatnonzero(program.exists(batch, only)), []
    if shape == "count":
        n = program.counts(batch)
        at = np.flatnonzero(n)
        return at, [pa.array(n[at])]
    if shape == "embeddings":
        mol, rows = program.least(batch)
        at = np.unique(mol)
        return at, [_nested(mol, rows, batch.size).take(pa.array(at))]
    matched, share = program.coverage(batch)
    return np.flatnonzero(np.diff(batch.first) > 0), [pa.array(matched), pa.array(share)]


def _batches(patterns: list[tuple[int, str]], shape: str, columns: list[str], chosen: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programs = [(i, Program(Matcher.of(s))) for i, s in patterns]
        for held in batches:
            if not held.num_rows:
                continue
            batch = Batch({c: held.column(c) for c in columns})
            ids = held.column("mol_id")
            wanted = None
            if chosen:
                lists = held.column(chosen)
                wanted = (np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False))
            for i, program in programs:
                only = None
                if wanted is not None:
                    only = np.zeros(batch.size, bool)
                    only[wanted[0][wanted[1] == i]] = True
                    if not only.any():
                        continue
                at, answers = _answer(program, batch, shape, only)
                if len(at):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), i)), *answers], ["mol_id", "query_id", *(c.split()[0] for c in SHAPES[shape].split(", ")[1:])])

    return run


def by_batch(packed: DataFrame, patterns: list[tuple[int, Pattern]], shape: str = "count", chosen: str | None = None) -> DataFrame:
    """(mol_id, query_id, ...) of the molecules that a pattern matches, and with coverage of all: n, embeddings, or matched and coverage, by shape.

    packed has mol_id and the PACKED columns, of which only those are read that the patterns name. chosen: an array column of query_id, for existence
    of just these patterns. Nothing is shuffled, and the driver gets nothing.
    """
    patterns = _texts(patterns)
    columns = sorted(set().union(*(Program(Matcher.of(s)).names for _, s in patterns))) if patterns else ["atom_hidden_h"]
    return packed.select("mol_id", *([chosen] if chosen else []), *columns).mapInArrow(_batches(patterns, shape, columns, chosen), f"mol_id long, query_id long{SHAPES[shape]}")


def _query(pattern: Pattern) -> Query:
    return parse(pattern) if isinstance(pattern, str) else pattern


def _by_rows(corpus: Corpus, query: Query, shape: str, joined: bool) -> DataFrame | None:
    """The answer without joins, where the corpus has packed rows and joins are not asked for, or where these would not do."""
    if corpus.packed is not None and not (joined and not joins.needs_kernel(query)):
        return by_batch(corpus.packed, [(0, query)], shape).drop("query_id")
    if joins.needs_kernel(query):
        found = by_kernel(corpus.molecules, [(0, query)], shape)
        return found.drop("query_id") if shape == "coverage" else found.where("matched").drop("query_id")
    return None


def exists(corpus: Corpus, smarts: Pattern, joined: bool = False) -> DataFrame:
    """(mol_id) of the molecules that the pattern matches; joined: by joins if they can say it."""
    query = _query(smarts)
    if (found := _by_rows(corpus, query, "exists", joined)) is not None:
        return found.select("mol_id")
    return joins.matching(corpus, query)


def counts(corpus: Corpus, smarts: Pattern, joined: bool = False) -> DataFrame:
    """(mol_id, n): the number of distinct sets of atoms that the pattern lies on, for molecules with any."""
    query = _query(smarts)
    if (found := _by_rows(corpus, query, "count", joined)) is not None:
        return found.select("mol_id", "n")
    key = F.array_sort(F.array(*[f"q{q}" for q in range(len(query.atoms))]))
    return joins.embeddings(corpus, query).select("mol_id", key.alias("key")).distinct().groupBy("mol_id").agg(F.count(F.lit(1)).alias("n"))


def at_least(corpus: Corpus, needs: list[tuple[int, Pattern, int]]) -> DataFrame:
    """(mol_id, query_id) of the molecules on which a pattern lies `need` times or more; needs: (query_id, pattern, need). A need below 1 is met by every molecule with atoms."""
    table = corpus.packed.sparkSession.createDataFrame([(i, n) for i, _, n in needs], "query_id long, need long")
    found = by_batch(corpus.packed, [(i, p) for i, p, n in needs if n > 0], "count").join(table, "query_id").where("n >= need").select("mol_id", "query_id")
    always = [F.lit(i).cast("long") for i, _, n in needs if n < 1]
    return found.union(corpus.packed.select("mol_id", F.explode(F.array(*always)))) if always else found


def embeddings(corpus: Corpus, smarts: Pattern, joined: bool = False) -> DataFrame:
    """(mol_id, embeddings): for each set of atoms the least mapping, ordered by the sorted sets."""
    query = _query(smarts)
    if (found := _by_rows(corpus, query, "embeddings", joined)) is not None:
        return found.select("mol_id", "embeddings")
    mapping = F.array(*[f"q{q}" for q in range(len(query.atoms))])
    least = joins.embeddings(corpus, query).select("mol_id", F.array_sort(mapping).alias("key"), mapping.alias("mapping")).groupBy("mol_id", "key").agg(F.min("mapping").alias("mapping"))
    return least.groupBy("mol_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "mapping"))), lambda x: x["mapping"]).alias("embeddings"))


def coverage(corpus: Corpus, smarts: Pattern, joined: bool = False) -> DataFrame:
    """(mol_id, matched, coverage) of every molecule with atoms: the share of atoms and bonds that any embedding touches."""
    query = _query(smarts)
    if (shown := _by_rows(corpus, query, "coverage", joined)) is not None:
        return shown.select("mol_id", "matched", "coverage")
    found = joins.embeddings(corpus, query)
    atoms = found.select("mol_id", F.explode(F.array(*[f"q{q}" for q in range(len(query.atoms))])).alias("x")).distinct().select("mol_id")
    parts = atoms.union(joins.touched_bonds(corpus, query, found).select("mol_id")) if query.bonds else atoms
    touched = parts.groupBy("mol_id").agg(F.count(F.lit(1)).alias("touched"))
    size = corpus.atoms.select("mol_id").union(corpus.bonds.select("mol_id")).groupBy("mol_id").agg(F.count(F.lit(1)).alias("size"))
    return size.join(touched, "mol_id", "left").select("mol_id", F.col("touched").isNotNull().alias("matched"), (F.coalesce("touched", F.lit(0)) / F.col("size")).alias("coverage"))
