"""Molecules as two long tables, one row an atom and one row a bond, and as one packed row each, keyed by mol_id; readers and writers of them.

A text that is no molecule gives no rows there, and a row with its error in `errors`. Each distinct text is prepared once, and what
comes of it is stored, so that no later use repeats the work and a very frequent text is no hot key of an aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from graphsieve.chem.perception import Molecule, perceive, prepare
from graphsieve.chem.smiles import Atom, Bond, Graph, SmilesError
from graphsieve.plans.columnar import ATOM_TYPES, BOND_TYPES, packed
from graphsieve.workspace import spread, written

FORMAT_VERSION = 2
#: Texts that one task prepares, about half a millisecond each.
TEXTS = 20_000
#: So many texts, of some 3 KB as they are prepared, are broadcast to the molecules; these never are, however few bytes their ids take.
FEW_TEXTS = 5_000
#: Molecules whose atoms and bonds one task unfolds, writes, indexes or groups.
MOLECULES = 20_000
#: Atoms and bonds of graphs that one task looks up, and graphs with about as many that it prepares.
ROWS = 200_000
ATOM_FIELDS = {
    "z": "int", "isotope": "int", "aromatic": "boolean", "charge": "int", "degree": "int", "connectivity": "int", "implicit_h": "int", "total_h": "int", "valence": "int",
    "hyb": "int", "hetero": "int", "aliph_hetero": "int", "ring_count": "int", "min_ring": "int", "ring_bonds": "int", "in_ring": "boolean", "component": "int", "hidden_h": "boolean",
}
BOND_FIELDS = {"a": "int", "b": "int", "label": "string", "in_ring": "boolean"}
PACKED = (*(f"atom_{k}" for k in ATOM_TYPES), *(f"bond_{k}" for k in BOND_TYPES))
_TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
_ATOM, _BOND = {"atom_id": "int", **ATOM_FIELDS}, {"bond_id": "int", **BOND_FIELDS}
PREPARED = (
    "smiles string, molecules long, error string, error_start int, error_end int, "
    f"atoms array<struct<{','.join(f'{k}:{v}' for k, v in _ATOM.items())}>>, bonds array<struct<{','.join(f'{k}:{v}' for k, v in _BOND.items())}>>, " + ", ".join(f"{k} binary" for k in PACKED)
)


def _lists(sizes: list[int], fields: dict[str, str], values: dict[str, list]) -> pa.Array:
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    made = pa.StructArray.from_arrays([pa.array(values[k], _TYPES[v]) for k, v in fields.items()], list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)


def _prepared(texts: list[str | None], numbers: pa.Array) -> pa.RecordBatch:
    errors: list[tuple] = []
    molecules: list[Molecule | None] = []
    for text in texts:
        try:
            molecules.append(prepare(text) if (text or "").strip() else None)
            errors.append((None, None, None) if molecules[-1] else ("empty_target", None, None))
        except SmilesError as e:
            molecules.append(None)
            errors.append(("invalid_target_smiles", e.start, e.end))
    columns = [pa.array(texts, pa.string()), numbers, *(pa.array([e[i] for e in errors], pa.string() if i == 0 else pa.int32()) for i in range(3))]
    return pa.RecordBatch.from_arrays([*columns, *_columns(molecules)], ["smiles", "molecules", "error", "error_start", "error_end", "atoms", "bonds", *PACKED])


def _columns(molecules: list[Molecule | None]) -> list[pa.Array]:
    """Lists of atoms and of bonds, and the packed columns, of each molecule."""
    known = [m for m in molecules if m is not None]
    atoms = {k: [v for m in known for v in getattr(m, k)] for k in ATOM_FIELDS} | {"atom_id": [i for m in known for i in range(len(m))]}
    bonds = {k: [getattr(x, k) for m in known for x in m.graph.bonds] for k in "ab"} | {"bond_id": [i for m in known for i in range(len(m.label))], "label": [x for m in known for x in m.label], "in_ring": [x for m in known for x in m.bond_ring]}
    lists = [_lists([len(m) if m else 0 for m in molecules], _ATOM, atoms), _lists([len(m.label) if m else 0 for m in molecules], _BOND, bonds)]
    made = packed(molecules)
    return lists + [made[k] for k in PACKED]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            rows = batch.slice(start, 1000)
            yield _prepared(rows.column("smiles").to_pylist(), rows.column("molecules"))


@dataclass
class Corpus:
    """molecules (mol_id, smiles), atoms (mol_id, atom_id, ...), bonds (mol_id, bond_id, a, b, label, in_ring), errors (mol_id, smiles, error, ...),
    packed (mol_id, smiles, PACKED columns), one row a molecule, or None where there are only graphs; texts (molecules, PACKED columns), one row for each
    distinct text of packed with the number of molecules that have it, or None where that was not stored."""

    molecules: DataFrame
    atoms: DataFrame
    bonds: DataFrame
    errors: DataFrame
    packed: DataFrame | None = None
    texts: DataFrame | None = None

    @property
    def directed(self) -> DataFrame:
        """Every bond from both sides."""
        turned = self.bonds.select("mol_id", "bond_id", F.col("b").alias("a"), F.col("a").alias("b"), "label", "in_ring")
        return self.bonds.select("mol_id", "bond_id", "a", "b", "label", "in_ring").union(turned)

    def local(self, partitions: int) -> Corpus:
        """The same with atoms and bonds dealt by mol_id and kept, so that every join of a pattern stays within its partition.

        Spark knows how they are dealt once they are computed, so count them first, and only while spark.sql.requireAllClusterKeysForCoPartition
        is false, which is left to the caller; otherwise it deals anew by mol_id and atom.
        """
        atoms, bonds = (df.repartition(partitions, "mol_id").persist() for df in (self.atoms, self.bonds))
        return Corpus(self.molecules, atoms, bonds, self.errors, self.packed, self.texts)

    def write(self, path: str, shards: int | None = None) -> None:
        """Parquet with zstd; with shards, partitioned by shard_id, the hash of mol_id. The tables are written side by side."""
        spark = self.molecules.sparkSession
        tables = {n: df for n in ("molecules", "atoms", "bonds", "errors", "packed") if (df := getattr(self, n)) is not None}

        def one(name: str) -> None:
            df = tables[name]
            writer = (df.withColumn("shard_id", F.pmod(F.xxhash64("mol_id"), F.lit(shards))) if shards else df).write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy("shard_id") if shards else writer).parquet(f"{path}/{name}")

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(one, tables))
        about = [(json.dumps({"format_version": FORMAT_VERSION, "tables": {n: tables[n].schema.json() for n in tables}, "shards": shards}),)]
        spark.createDataFrame(about, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def read(cls, spark: SparkSession, path: str, shards: list[int] | None = None) -> Corpus:
        """What `write` wrote, or some of its shards. The version stands in a file of its own, so that no table is read for it."""
        about = json.loads(spark.read.text(f"{path}/about").first().value)
        if about["format_version"] != FORMAT_VERSION:
            raise ValueError(f"format version {about['format_version']}, not {FORMAT_VERSION}")

        def table(name: str) -> DataFrame | None:
            if name not in about["tables"]:
                return None
            schema = StructType.fromJson(json.loads(about["tables"][name]))  # a table without rows has no files to tell
            df = spark.read.schema(schema.add("shard_id", IntegerType()) if about["shards"] else schema).parquet(f"{path}/{name}")
            return (df if shards is None else df.where(F.col("shard_id").isin(shards))).drop("shard_id")

        return cls(*(table(n) for n in ("molecules", "atoms", "bonds", "errors", "packed")))


def from_smiles(molecules: DataFrame) -> Corpus:
    """molecules: mol_id bigint, smiles string. Distinct texts are counted and prepared now and stored in the shared folder; the tables read them from there, where there are few of them by tasks of MOLECULES molecules, dealt by mol_id."""
    molecules = molecules.select(F.col("mol_id").cast("long").alias("mol_id"), F.col("smiles").cast("string").alias("smiles"))
    texts = written(molecules.groupBy("smiles").agg(F.count(F.lit(1)).alias("molecules")), "texts")
    distinct, rows = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("molecules"), F.lit(0))).first()
    prepared = written(spread(texts, distinct, TEXTS).mapInArrow(_prepare, PREPARED), "prepared")
    few = distinct <= FEW_TEXTS
    molecules = spread(molecules, rows, MOLECULES, "mol_id") if few else molecules  # a few small files of ids unfold to very many atoms
    joined = molecules.join(F.broadcast(prepared) if few else prepared.hint("merge"), molecules.smiles.eqNullSafe(prepared.smiles)).drop(prepared.smiles)
    atoms = joined.select("mol_id", F.explode("atoms").alias("x")).select("mol_id", "x.*")
    bonds = joined.select("mol_id", F.explode("bonds").alias("x")).select("mol_id", "x.*")
    errors = joined.where("error IS NOT NULL").select("mol_id", "smiles", "error", "error_start", "error_end")
    good = prepared.where("error IS NULL").select("molecules", *PACKED)
    return Corpus(molecules, atoms, bonds, errors, joined.where("error IS NULL").select("mol_id", "smiles", *PACKED), good)


def from_graphs(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generic graphs (mol_id, atom_id) and (mol_id, a, b, label): the bonds that are good, and those that are not with their error.

    An endpoint that is no atom, a loop, and a second bond between the same atoms are errors.
    """
    judged = _judged(atoms, bonds, atoms.count() + bonds.count())
    return judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL")


def _judged(atoms: DataFrame, bonds: DataFrame, rows: int) -> DataFrame:
    """The bonds with their error. Ends are looked up by sorted joins within shares of ROWS rows: numbers in order take so few bytes
    in a shuffle that Spark would broadcast millions of them, and the driver hold them."""
    ends = spread(bonds.select("mol_id", "a", "b", "label", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), rows, ROWS, "mol_id", "low")
    ends = ends.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mol_id", "low", "high")))
    ids = spread(atoms.select("mol_id", F.col("atom_id").alias("low")), rows, ROWS, "mol_id", "low").distinct()
    found = ends.join(ids.withColumn("has_low", F.lit(True)).hint("merge"), ["mol_id", "low"], "left")
    other = ids.select("mol_id", F.col("low").alias("high"), F.lit(True).alias("has_high"))
    found = spread(found, rows, ROWS, "mol_id", "high").join(other.hint("merge"), ["mol_id", "high"], "left")
    error = F.when(F.col("low") == F.col("high"), "self_loop").when(F.col("has_low").isNull() | F.col("has_high").isNull(), "unknown_atom").when(F.col("n") > 1, "duplicate_bond")
    return found.withColumn("error", error).select("mol_id", "a", "b", "label", "error")


_GRAPH_ATOM = {"atom_id": "int", "z": "int", "aromatic": "boolean", "isotope": "int", "charge": "int", "hydrogens": "int"}


def _perceived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            rows = batch.slice(start, 1000)
            molecules = []
            for atoms, bonds in zip(rows.column("vertices").to_pylist(), rows.column("edges").to_pylist(), strict=True):
                atoms = sorted(atoms, key=lambda x: x["atom_id"])
                place = {x["atom_id"]: i for i, x in enumerate(atoms)}
                graph = Graph([Atom(x["z"], bool(x["aromatic"]), x["isotope"], x["charge"] or 0, x["hydrogens"]) for x in atoms])
                graph.bonds = [Bond(place[x["a"]], place[x["b"]], x["label"]) for x in sorted(bonds or [], key=lambda x: (x["a"], x["b"]))]
                graph.order = [[w for w, _ in near] for near in graph.neighbours()]
                molecules.append(perceive(graph))
            yield pa.RecordBatch.from_arrays([rows.column("mol_id"), *_columns(molecules)], ["mol_id", "atoms", "bonds", *PACKED])


def corpus_of_graphs(atoms: DataFrame, bonds: DataFrame) -> Corpus:
    """A corpus of generic graphs: atoms (mol_id, atom_id, and as far as there are z, aromatic, isotope, charge, hydrogens), bonds (mol_id, a, b, label).

    Absent z make atoms without an element, which only wildcards and topology match; absent hydrogens go by valence. atom_id is numbered anew from 0 in its
    order. Graphs with a bad bond (see from_graphs) are in errors only.
    """
    rows = atoms.count() + bonds.count()
    judged = written(_judged(atoms, bonds, rows), "judged")
    good, bad = judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL")
    dealt = lambda df: spread(df, rows, ROWS, "mol_id")
    errors = dealt(bad.select("mol_id", "error")).groupBy("mol_id").agg(F.min("error").alias("error")).select("mol_id", F.lit(None).cast("string").alias("smiles"), "error", F.lit(None).cast("int").alias("error_start"), F.lit(None).cast("int").alias("error_end"))
    vertex = F.struct(*[(F.col(k) if k in atoms.columns else F.lit(None)).cast(v).alias(k) for k, v in _GRAPH_ATOM.items()])
    vertices = dealt(atoms.select("mol_id", vertex.alias("v"))).distinct().groupBy("mol_id").agg(F.collect_list("v").alias("vertices"))
    edges = dealt(good).groupBy("mol_id").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "label")).alias("edges"))
    whole = vertices.join(edges.hint("merge"), "mol_id", "left").join(errors.select("mol_id").hint("merge"), "mol_id", "left_anti").select(F.col("mol_id").cast("long").alias("mol_id"), "vertices", "edges")
    prepared = written(whole.mapInArrow(_perceived, "mol_id long" + PREPARED[PREPARED.index(", atoms") :]), "graphs")
    exploded = [prepared.select("mol_id", F.explode(c).alias("x")).select("mol_id", "x.*") for c in ("atoms", "bonds")]
    empty = F.lit(None).cast("string").alias("smiles")
    return Corpus(prepared.select("mol_id", empty), *exploded, errors, prepared.select("mol_id", empty, *PACKED))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """One pattern a line, as (query_id, smarts); empty lines and those that begin with # are left out."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    return lines.select(F.xxhash64("value").alias("query_id"), F.trim("value").alias("smarts"))
