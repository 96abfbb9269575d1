"""Screening: which molecules may match which patterns, from counts and small neighbourhoods, before any exact matching.

A molecule is described by how often each fact holds of its atoms and bonds, and by how often each path of two to four atoms
and each star of three arms occurs; a pattern by how many it needs. Facts come only from what an expression forces: an `and` joins
them, an `or` keeps the common ones, a negation gives none; a bond on a cycle of the pattern lies in a ring. What a pattern does not
force in a path is open and fits any label. Every hit is among the candidates.

An atom is spelled by its number, aromaticity, degree and hydrogens (6Ad2h2), a bond by its kind and whether it is in a ring (S!, A@).
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsieve.operators.match import Pattern, by_batch
from graphsieve.plans.columnar import LABELS, Batch
from graphsieve.plans.kernel import STATES, bond_states
from graphsieve.smarts import edit
from graphsieve.smarts.query import Query, parse
from graphsieve.sources.tables import MOLECULES, Corpus
from graphsieve.workspace import spread, written

#: Index rows of the keys that are asked for that one task sums by molecule.
POSTINGS = 1_000_000
FAMILIES = ("count", "edge", "path3", "path4", "star3")


def forced(expr: tuple) -> frozenset[str]:
    """Facts that hold of every atom that the expression accepts."""
    op, *rest = expr
    if op in ("and", "low"):
        return frozenset().union(*map(forced, rest))
    if op == "or":
        return frozenset.intersection(*map(forced, rest))
    value = rest[0] if rest else None
    if op == "symbol":
        return frozenset({f"z{value[0]}", f"aromatic{int(value[1])}"})
    if op == "isotope":
        return frozenset({f"z{value[1]}", f"aromatic{int(value[2])}"})
    if op == "number":
        return frozenset({f"z{value}"})
    if op in ("aromatic", "aliphatic"):
        return frozenset({f"aromatic{int(op == 'aromatic')}"})
    if op in ("degree", "total_h"):
        span = (1, 1) if value is None else value
        return frozenset({f"{op}{span[0]}"}) if span[0] == span[1] else frozenset()
    if op in ("ring_count", "min_ring", "ring_bonds"):
        return frozenset({"ring"}) if value is None or (value[0] or 0) > 0 else frozenset()
    if op == "recursive":
        return forced(value.atoms[0].expr)
    return frozenset()


def _bond_code(expr: tuple | None) -> tuple[str | None, bool]:
    """The one kind of bond that the expression leaves, if so, and whether it must lie in a ring."""
    states = bond_states(expr)
    kinds = {"S" if label in "SUW" else label for label, _ in states}
    return (kinds.pop() if len(kinds) == 1 else None), bool(states) and states != STATES and all(ring for _, ring in states)


def _atom_pattern(facts: frozenset[str]) -> str:
    known = {name: next((f[len(name) :] for f in sorted(facts) if re.fullmatch(name + r"\d+", f)), None) for name in ("z", "aromatic", "degree", "total_h")}
    return (known["z"] or r"\d+") + {"1": "a", "0": "A", None: "[aA]"}[known["aromatic"]] + "d" + (known["degree"] or r"\d+") + "h" + (known["total_h"] or r"\d+")


def _bond_pattern(code: tuple[str | None, bool]) -> str:
    return (code[0] or "[SDTQA]") + ("@" if code[1] else "[@!]")


def requirements(query: Query) -> list[tuple[str, str, int]]:
    """(family, key, least count): keys of counts are facts, of the others patterns over features as `features` spells them."""
    out: Counter = Counter()
    cyclic = [edit.is_cycle_edge(query, i) for i in range(len(query.bonds))]
    inside = {v for b, ring in zip(query.bonds, cyclic, strict=True) if ring for v in (b.a, b.b)}
    facts = [forced(a.expr) | ({"ring"} if v in inside else set()) for v, a in enumerate(query.atoms)]
    out["count", "atoms"] = len(query.atoms)
    for own in facts:
        for fact in own:
            out["count", f"atom_{fact}"] += 1
    codes = [(kind, ring or on_cycle) for (kind, ring), on_cycle in zip((_bond_code(b.expr) for b in query.bonds), cyclic, strict=True)]
    for kind, ring in codes:
        if kind:
            out["count", f"bond_{kind}"] += 1
        if ring:
            out["count", "bond_ring"] += 1
    near = query.neighbours()
    atom = [_atom_pattern(f) for f in facts]
    bond = [_bond_pattern(c) for c in codes]
    blank = {_atom_pattern(frozenset()), _bond_pattern((None, False))}

    def add(family: str, ways: list[list[str]]) -> None:
        if set(ways[0]) - blank:
            out[family, "|".join(sorted({"^" + "-".join(w) + "$" for w in ways}))] += 1

    for b, code in zip(query.bonds, bond, strict=True):
        add("edge", [w := [atom[b.a], code, atom[b.b]], w[::-1]])
    for c, links in enumerate(near):
        for (x, i), (y, j) in itertools.combinations(links, 2):
            if x != y:
                add("path3", [w := [atom[x], bond[i], atom[c], bond[j], atom[y]], w[::-1]])
        for arms in itertools.combinations(links, 3):
            if len({x for x, _ in arms}) == 3:
                add("star3", [[atom[c], *(bond[i] + atom[x] for x, i in p)] for p in itertools.permutations(arms)])
    for k, b in enumerate(query.bonds):
        for (x, i), (y, j) in itertools.product(near[b.a], near[b.b]):
            if i != k and j != k and x != y and x != b.b and y != b.a:
                add("path4", [w := [atom[x], bond[i], atom[b.a], bond[k], atom[b.b], bond[j], atom[y]], w[::-1]])
    return [(family, key, n) for (family, key), n in sorted(out.items())]


def requirement_table(spark: SparkSession, patterns: list[tuple[int, Pattern]]) -> DataFrame:
    rows = [(i, *r) for i, p in patterns for r in requirements(parse(p) if isinstance(p, str) else p)]
    return spark.createDataFrame(rows, "query_id long, family string, key string, need long")


_KINDS = ["S" if label in "SUW" else label for label in LABELS]
_FEATURES = "mol_id long, family string, key string, n long"


def _counted(mol: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Molecule, code and number of each pair of them."""
    order = np.lexsort((code, mol))
    mol, code = mol[order], code[order]
    at = np.flatnonzero(np.concatenate([[True], (mol[1:] != mol[:-1]) | (code[1:] != code[:-1])])) if len(mol) else np.zeros(0, np.int64)
    return mol[at], code[at], np.diff(np.append(at, len(mol)))


def _pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line number and element of every line's range low to high."""
    many = np.maximum(high - low, 0)
    line = np.repeat(np.arange(len(low)), many)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


def _shapes(batch: Batch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Family, and of its keys molecule, place in the list of spellings, number and the list, of the batch.

    Labels are numbered in the order of their spelling, so that the lesser of two spellings is the lesser number.
    """
    f = batch.field
    label = np.stack([np.maximum(f("z"), 0), f("aromatic"), f("degree"), f("total_h")], axis=1)
    distinct, number = np.unique(label, axis=0, return_inverse=True)
    spelled = [f"{z}{'a' if arom else 'A'}d{d}h{h}" for z, arom, d, h in distinct.tolist()]
    order = np.argsort(spelled) if spelled else np.zeros(0, np.int64)
    names, rank = [spelled[i] for i in order], np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    atom = rank[number.ravel()] if len(rank) else np.zeros(0, np.int64)
    kinds = sorted({k + r for k in _KINDS for r in "!@"})
    state = np.array([kinds.index(k + r) for k in _KINDS for r in "!@"])
    n, b = max(len(names), 1), len(kinds)
    origin = batch.key // max(batch.atoms, 1)
    seen = batch.shown[origin] & batch.shown[batch.to]
    x, y, bond = origin[seen], batch.to[seen], state[batch.state[seen]]
    begin = np.searchsorted(x, np.arange(batch.atoms + 1))

    def keyed(family: str, at: np.ndarray, parts: list[np.ndarray]):
        code = back = np.zeros(len(at), np.int64)
        for k, (p, q) in enumerate(zip(parts, parts[::-1], strict=True)):
            code, back = code * (b if k % 2 else n) + p, back * (b if k % 2 else n) + q
        mol, code, many = _counted(batch.mol[at], np.minimum(code, back) if family != "star3" else code)
        keys, place = np.unique(code, return_inverse=True)
        texts = []
        for key in keys.tolist():
            shown = []
            for k in reversed(range(len(parts))):
                key, v = divmod(key, b if k % 2 else n)
                shown.append(kinds[v] if k % 2 else names[v])
            shown.reverse()
            texts.append("-".join(shown) if family != "star3" else "-".join([shown[0], *(shown[k] + shown[k + 1] for k in (1, 3, 5))]))
        return family, mol, place, many, texts

    once = np.flatnonzero(x < y)
    yield keyed("edge", x[once], [atom[x[once]], bond[once], atom[y[once]]])
    first, second = _pairs(np.arange(len(x)) + 1, begin[x + 1])
    yield keyed("path3", x[first], [atom[y[first]], bond[first], atom[x[first]], bond[second], atom[y[second]]])
    line, third = _pairs(second + 1, begin[x[second] + 1])
    arms = np.sort(np.stack([bond[e] * n + atom[y[e]] for e in (first[line], second[line], third)], axis=1), axis=1) if len(line) else np.zeros((0, 3), np.int64)
    yield keyed("star3", x[third], [atom[x[third]], *(v for k in range(3) for v in (arms[:, k] // n, arms[:, k] % n))])
    line, left = _pairs(begin[x[once]], begin[x[once] + 1])
    middle = once[line]
    apart = y[left] != y[middle]
    left, middle = left[apart], middle[apart]
    line, right = _pairs(begin[y[middle]], begin[y[middle] + 1])
    left, middle = left[line], middle[line]
    apart = (y[right] != x[middle]) & (y[right] != y[left])
    left, middle, right = left[apart], middle[apart], right[apart]
    yield keyed("path4", x[middle], [atom[y[left]], bond[left], atom[x[middle]], bond[middle], atom[y[middle]], bond[right], atom[y[right]]])


def _facts(batch: Batch) -> Iterator[tuple[str, np.ndarray]]:
    """Count keys with the number of each molecule."""
    f = batch.field
    count = lambda mask: np.bincount(batch.mol[mask & batch.shown], minlength=batch.size)
    yield "atoms", count(np.ones(batch.atoms, bool))
    for z in np.unique(f("z")[f("z") >= 0]).tolist():
        yield f"atom_z{z}", count(f("z") == z)
    for k in (0, 1):
        yield f"atom_aromatic{k}", count((f("z") >= 0) & (f("aromatic") == k))
    for name in ("degree", "total_h"):
        for v in np.unique(f(name)).tolist():
            yield f"atom_{name}{v}", count(f(name) == v)
    yield "atom_ring", count(f("in_ring") == 1)
    state = batch.bond_field("state")[:, 0]
    for kind in sorted(set(_KINDS)):
        yield f"bond_{kind}", np.bincount(batch.bond_mol[np.isin(state // 2, [i for i, k in enumerate(_KINDS) if k == kind])], minlength=batch.size)
    yield "bond_ring", np.bincount(batch.bond_mol[state % 2 == 1], minlength=batch.size)


_READ = ["atom_hidden_h", "atom_z", "atom_aromatic", "atom_degree", "atom_total_h", "atom_in_ring", "bond_a", "bond_b", "bond_state"]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in batches:
        if not held.num_rows:
            continue
        batch, ids = Batch({c: held.column(c) for c in _READ}), held.column("mol_id")

        def rows(family: str, mol: np.ndarray, keys: pa.Array, n: np.ndarray, ids: pa.Array = ids) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(mol)), pa.array([family] * len(mol), pa.string()), keys, pa.array(n.astype(np.int64))], ["mol_id", "family", "key", "n"])

        for key, n in _facts(batch):
            mol = np.flatnonzero(n)
            yield rows("count", mol, pa.array([key] * len(mol), pa.string()), n[mol])
        for family, mol, place, n, texts in _shapes(batch):
            yield rows(family, mol, pa.array(texts, pa.string()).take(pa.array(place)), n)


def features(corpus: Corpus) -> DataFrame:
    """(mol_id, family, key, n): counts of facts, and of paths and stars with each key spelled one way; from packed rows without a shuffle."""
    if corpus.packed is None:
        return joined_features(corpus)
    return corpus.packed.select("mol_id", *_READ).mapInArrow(_index, _FEATURES)


_WORDS = "family string, key string, molecules long, total long, most long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each batch with their numbers; a row stands for as many molecules as its column of that name says."""

    def rows(family: str, keys: list[str], *numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([family] * len(keys), pa.string()), pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["family", "key", "molecules", "total", "most"])

    for held in batches:
        if not held.num_rows:
            continue
        batch, times = Batch({c: held.column(c) for c in _READ}), held.column("molecules").to_numpy()
        facts = {key: (times[n > 0].sum(), (n * times).sum(), n.max()) for key, n in _facts(batch) if n.any()}
        yield rows("count", list(facts), *np.array(list(facts.values()), np.int64).reshape(-1, 3).T)
        for family, mol, place, n, texts in _shapes(batch):
            molecules, total, most = (np.zeros(len(texts), np.int64) for _ in range(3))
            np.add.at(molecules, place, times[mol])
            np.add.at(total, place, n * times[mol])
            np.maximum.at(most, place, n)
            yield rows(family, texts, molecules, total, most)


def dictionary(index: DataFrame | Corpus) -> DataFrame:
    """(family, key, molecules, total, most): the distinct keys of an index, which are bounded by the labels there are, with their numbers.

    Of a corpus they come without its index: summed by batches of packed rows, and where its distinct texts are stored, from these, each of them once.
    """
    if isinstance(index, Corpus):
        if index.packed is None:
            return dictionary(joined_features(index))
        held = index.packed.withColumn("molecules", F.lit(1).cast("long")) if index.texts is None else index.texts
        sums = [F.sum("molecules").alias("molecules"), F.sum("total").alias("total"), F.max("most").alias("most")]
        return held.select("molecules", *_READ).mapInArrow(_words, _WORDS).groupBy("family", "key").agg(*sums)
    return index.groupBy("family", "key").agg(F.count(F.lit(1)).alias("molecules"), F.sum("n").alias("total"), F.max("n").alias("most"))


def joined_features(corpus: Corpus) -> DataFrame:
    """The same by joins over atoms and bonds tables, for corpora without packed rows."""
    atoms, bonds = corpus.atoms, corpus.bonds
    shown = atoms.where("NOT hidden_h")
    facts = F.array_compact(
        F.array(
            F.lit("atoms"), F.concat(F.lit("atom_z"), F.col("z").cast("string")), F.when(F.col("z").isNotNull(), F.concat(F.lit("atom_aromatic"), F.col("aromatic").cast("int").cast("string"))),
            F.concat(F.lit("atom_degree"), F.col("degree").cast("string")), F.concat(F.lit("atom_total_h"), F.col("total_h").cast("string")), F.when(F.col("in_ring"), F.lit("atom_ring")),
        )
    )
    kind = F.when(F.col("label").isin("S", "U", "W"), "S").otherwise(F.col("label"))
    bond_facts = F.array_compact(F.array(F.concat(F.lit("bond_"), kind), F.when(F.col("in_ring"), F.lit("bond_ring"))))
    counts = shown.select("mol_id", F.explode(facts).alias("key")).union(bonds.select("mol_id", F.explode(bond_facts).alias("key"))).withColumn("family", F.lit("count"))
    codes = shown.select("mol_id", "atom_id", F.concat(F.coalesce("z", F.lit(0)).cast("string"), F.when(F.col("aromatic"), "a").otherwise("A"), F.lit("d"), "degree", F.lit("h"), "total_h").alias("code"))
    arcs = corpus.directed.select("mol_id", "a", "b", F.concat(kind, F.when(F.col("in_ring"), "@").otherwise("!")).alias("bond"))
    arcs = arcs.join(codes.select("mol_id", F.col("atom_id").alias("a"), F.col("code").alias("ca")), ["mol_id", "a"]).join(codes.select("mol_id", F.col("atom_id").alias("b"), F.col("code").alias("cb")), ["mol_id", "b"])

    def spelled(*parts: str) -> F.Column:
        return F.least(F.concat_ws("-", *parts), F.concat_ws("-", *parts[::-1]))

    edges = arcs.where("a < b").select("mol_id", spelled("ca", "bond", "cb").alias("key")).withColumn("family", F.lit("edge"))
    left = arcs.select("mol_id", F.col("a").alias("c"), F.col("ca").alias("cc"), F.col("b").alias("x"), F.col("cb").alias("cx"), F.col("bond").alias("bx"))
    right = arcs.select("mol_id", F.col("a").alias("c"), F.col("b").alias("y"), F.col("cb").alias("cy"), F.col("bond").alias("by"))
    third = arcs.select("mol_id", F.col("a").alias("c"), F.col("b").alias("w"), F.col("cb").alias("cw"), F.col("bond").alias("bw"))
    bent = left.join(right, ["mol_id", "c"]).where("x < y")
    path3 = bent.select("mol_id", spelled("cx", "bx", "cc", "by", "cy").alias("key")).withColumn("family", F.lit("path3"))
    arms = F.array_sort(F.array(F.concat("bx", "cx"), F.concat("by", "cy"), F.concat("bw", "cw")))
    star3 = bent.join(third, ["mol_id", "c"]).where("y < w").select("mol_id", F.concat_ws("-", "cc", F.array_join(arms, "-")).alias("key")).withColumn("family", F.lit("star3"))
    middle = arcs.where("a < b").select("mol_id", F.col("a").alias("p"), F.col("b").alias("q"), "bond", "ca", "cb")
    start = left.select("mol_id", F.col("c").alias("p"), "x", "cx", "bx")
    end = right.select("mol_id", F.col("c").alias("q"), "y", "cy", "by")
    long_ = middle.join(start, ["mol_id", "p"]).where("x <> q").join(end, ["mol_id", "q"]).where("y <> p AND x <> y")
    path4 = long_.select("mol_id", spelled("cx", "bx", "ca", "bond", "cb", "by", "cy").alias("key")).withColumn("family", F.lit("path4"))
    parts = [counts, edges, path3, path4, star3]
    rows = parts[0].select("mol_id", "family", "key")
    for part in parts[1:]:
        rows = rows.union(part.select("mol_id", "family", "key"))
    return rows.groupBy("mol_id", "family", "key").agg(F.count(F.lit(1)).alias("n"))


def _fitting(patterns: list[tuple[str, str, int]]):
    """Keys with the numbers of the patterns that they fit. Each pattern is compiled once a task; as a join, it would be for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(family, slot, re.compile(pattern).search) for family, pattern, slot in patterns]
        for batch in batches:
            known: dict[str, list[tuple[str, int]]] = {}
            for family, *word in zip(*(batch.column(c).to_pylist() for c in ("family", "key", "molecules")), strict=True):
                known.setdefault(family, []).append(word)
            for family, slot, fits in compiled:
                if found := [w for w in known.get(family, ()) if fits(w[0])]:
                    keys, molecules = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([family] * len(found)), pa.array(keys), pa.array(molecules), pa.array([slot] * len(found), pa.int32())], ["family", "key", "molecules", "slot"])

    return run


def candidates(index: DataFrame, needs: DataFrame, families: tuple[str, ...] = FAMILIES, words: DataFrame | None = None, share: float = 1.0) -> DataFrame:
    """(query_id, mol_id) of pairs in which the molecule has all that the pattern needs.

    What several patterns need alike is looked up once. It is held against words, the dictionary of distinct keys, taken from the index if it is not
    given; the keys that fit are stored, and only index rows of these keys are joined, dealt once by molecule, POSTINGS to a task, and summed there. share: how much of
    what words counts is in the index. The driver gets the needs, and they alone are broadcast, but for what Spark's own limit of size lets it; a key that most
    molecules have is split as any skewed one.
    """
    spark = index.sparkSession
    asked = [(r.query_id, r.family, r.key, r.need) for r in needs.where(F.col("family").isin(*families)).collect()]
    index = index.where(F.col("family").isin(*families))
    words = (dictionary(index) if words is None else words.where(F.col("family").isin(*families))).select("family", "key", "molecules")
    slots = {wanted: i for i, wanted in enumerate(sorted({(family, key) for _, family, key, _ in asked}))}
    patterns = [(family, key, i) for (family, key), i in slots.items() if family != "count"]
    shapes = spread(words.where("family <> 'count'"), 0, 1).mapInArrow(_fitting(patterns), "family string, key string, molecules long, slot int")
    facts = F.broadcast(spark.createDataFrame([(family, key, i) for (family, key), i in slots.items() if family == "count"], "family string, key string, slot int"))
    fits = written(shapes.union(words.join(facts, ["family", "key"]).select("family", "key", "molecules", "slot")), "fits")
    rows = int((fits.agg(F.sum("molecules")).first()[0] or 0) * share)
    held = spread(index.join(fits.drop("molecules"), ["family", "key"]).select("mol_id", "slot", "n"), rows, POSTINGS, "mol_id").groupBy("mol_id", "slot").agg(F.sum("n").alias("n"))
    needed = spark.createDataFrame([(i, slots[family, key], need) for i, family, key, need in asked], "query_id long, slot int, need long")
    total = needed.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    met = held.join(F.broadcast(needed), "slot").where("n >= need").groupBy("query_id", "mol_id").agg(F.count(F.lit(1)).alias("met"))
    return met.join(F.broadcast(total), "query_id").where("met = total").select("query_id", "mol_id")


def candidate_counts(index: DataFrame, needs: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(query_id, n) for every pattern of needs, 0 too."""
    found = candidates(index, needs, families).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return needs.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("found", F.lit(0)).alias("n"))


def may_match(index: DataFrame, needs: DataFrame) -> DataFrame:
    """The candidates by counts alone."""
    return candidates(index, needs, ("count",))


def exact(packed: DataFrame, found: DataFrame, patterns: list[tuple[int, Pattern]]) -> DataFrame:
    """(query_id, mol_id) of those candidates that match: each molecule is read once, with the list of patterns it is a candidate of."""
    lists = written(found.groupBy("mol_id").agg(F.collect_list("query_id").alias("chosen")), "chosen")
    return by_batch(spread(packed.join(lists.hint("merge"), "mol_id"), lists.count(), MOLECULES, "mol_id"), patterns, "exists", "chosen").select("query_id", "mol_id")


def hits(corpus: Corpus, index: DataFrame, patterns: list[tuple[int, Pattern]], words: DataFrame | None = None) -> DataFrame:
    """(query_id, mol_id) of exact matches: each pattern is matched with its candidates only."""
    return exact(corpus.packed, candidates(index, requirement_table(index.sparkSession, patterns), words=words), patterns)


def statistics(index: DataFrame | Corpus) -> DataFrame:
    """(family, keys, postings, total, most, atom_labels, bond_labels): of each family the distinct keys, index rows, features, and the labels its keys are made of;
    the family count, whose most frequent key stands once for each molecule, has no labels. Of an index, or of a corpus as `dictionary` takes it; its keys are stored."""
    words = written(dictionary(index), "words")
    every = F.filter(F.split("key", "-"), lambda x: x != "")
    labels = F.when(F.col("family") == "star3", F.concat(F.slice(every, 1, 1), F.flatten(F.transform(F.slice(every, 2, 3), lambda x: F.array(F.substring(x, 1, 2), F.substring(x, 3, 99)))))).otherwise(every)
    spelled = words.where("family <> 'count'").select("family", F.explode(labels).alias("label")).distinct()
    made = spelled.groupBy("family").agg(F.count_if(F.col("label").rlike("^[0-9]")).alias("atom_labels"), F.count_if(~F.col("label").rlike("^[0-9]")).alias("bond_labels"))
    sums = words.groupBy("family").agg(F.count(F.lit(1)).alias("keys"), F.sum("molecules").alias("postings"), F.sum("total").alias("total"), F.max("most").alias("most"))
    return sums.join(made, "family", "left").select("family", "keys", "postings", "total", "most", F.coalesce("atom_labels", F.lit(0)).alias("atom_labels"), F.coalesce("bond_labels", F.lit(0)).alias("bond_labels"))


def requirement_statistics(needs: DataFrame) -> DataFrame:
    """(query_id, family, features, required): how many different features a pattern needs, and how many in all."""
    return needs.groupBy("query_id", "family").agg(F.count(F.lit(1)).alias("features"), F.sum("need").alias("required"))


def mine(index: DataFrame | Corpus, least: int = 4, top: int | None = None) -> DataFrame:
    """(family, key, support): paths and stars that stand in `least` molecules or more, the most supported first within their family; of an index, or of a corpus as `dictionary` takes it."""
    found = dictionary(index).where("family <> 'count'").select("family", "key", F.col("molecules").alias("support")).where(F.col("support") >= least)
    if top is None:
        return found
    place = Window.partitionBy("family").orderBy(F.desc("support"), "key")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).drop("place")


def key_smarts(family: str | F.Column = "family", key: str | F.Column = "key") -> F.Column:
    """A feature key as a pattern that matches where the feature stands."""
    family, key = (F.col(x) if isinstance(x, str) else x for x in (family, key))
    parts = F.split(key, "-")

    def atom(x: F.Column) -> F.Column:
        found = [F.regexp_extract(x, r"^(\d+)([aA])d(\d+)h(\d+)$", i) for i in range(1, 5)]
        return F.concat(F.lit("["), F.when(found[0] == "0", F.lit("*")).otherwise(F.concat(F.lit("#"), found[0], F.lit(";"), found[1])), F.lit(";D"), found[2], F.lit(";H"), found[3], F.lit("]"))

    def bond(x: F.Column) -> F.Column:
        kind = F.substring(x, 1, 1)
        sign = F.when(kind == "S", "-").when(kind == "D", "=").when(kind == "T", "#").when(kind == "A", ":").otherwise("~")
        return F.concat(sign, F.when(F.substring(x, 2, 1) == "@", ";@").otherwise(";!@"))

    chain = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, atom(x)).otherwise(bond(x))), "")
    arms = F.transform(F.slice(parts, 2, 3), lambda x: F.concat(F.lit("("), bond(F.substring(x, 1, 2)), atom(F.substring(x, 3, 99)), F.lit(")")))
    return F.when(family == "star3", F.concat(atom(F.get(parts, 0)), F.array_join(arms, ""))).otherwise(chain)


def mined_patterns(index: DataFrame | Corpus, least: int = 4, top: int | None = None) -> DataFrame:
    """(family, smarts, support) of `mine`'s features as patterns; a pattern matches its support of molecules or more, as it allows further bonds."""
    return mine(index, least, top).select("family", key_smarts().alias("smarts"), "support")
