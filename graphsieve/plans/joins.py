"""A pattern lowered to joins over the atoms and bonds tables.

Atoms are taken in the order of the kernel, each next to an earlier one: a join with the bonds of a mapped atom, then with the
atoms table, where the predicates stand so that they reach the scan. Bonds that close rings are further equi-joins.
Recursive patterns become boolean columns of the atoms table, innermost first. Every join has mol_id in its key, so tables
that are stored by mol_id need no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsieve.plans.kernel import Matcher
from graphsieve.plans.predicates import atom_column, bond_column
from graphsieve.smarts.query import Query, primitives
from graphsieve.sources.tables import Corpus

MOST_ATOMS, MOST_COMPONENTS = 16, 3


def needs_kernel(query: Query) -> bool:
    """Whether joins would do badly, or can't say it: large or many-part patterns, stereo, two bonds between the same atoms."""
    pairs = {(min(b.a, b.b), max(b.a, b.b)) for b in query.bonds}
    inner = [node[1] for a in query.atoms for node, _ in primitives(a.expr) if node[0] == "recursive"]
    matcher_stereo = bool(Matcher(query).centres or Matcher(query).doubles)
    return len(query.atoms) > MOST_ATOMS or query.components > MOST_COMPONENTS or len(pairs) < len(query.bonds) or matcher_stereo or any(map(needs_kernel, inner))


def embeddings(corpus: Corpus, query: Query, anchored: bool = False, last_semi: bool = False) -> DataFrame:
    """(mol_id, q0, q1, ...): one row for every embedding; with last_semi, for every choice of all atoms but the last, which has no column."""
    matcher = Matcher(query)
    order = matcher.sequence(anchored)
    atoms, slots = corpus.atoms.where("NOT hidden_h"), {}
    for atom in query.atoms:
        for node, _ in primitives(atom.expr):
            if node[0] == "recursive" and id(node[1]) not in slots:
                name = f"r{len(slots)}"
                hit = embeddings(corpus, node[1], anchored=True).select("mol_id", F.col("q0").alias("atom_id"), F.lit(True).alias(name)).distinct()
                atoms = atoms.join(hit, ["mol_id", "atom_id"], "left")
                slots[id(node[1])] = F.col(name)

    def fitting(q: int) -> DataFrame:
        chosen = atoms.where(atom_column(query.atoms[q].expr, slots) & (F.col("degree") >= len(matcher.near[q])))
        return chosen.select("mol_id", F.col("atom_id").alias(f"q{q}"), *([F.col("component").alias(f"c{q}")] if query.atoms[q].group is not None else []))

    out, mapped = fitting(order[0]), [order[0]]
    for at, q in enumerate(order[1:], 1):
        links = [(w, i) for w, i in matcher.near[q] if w in mapped]
        added = fitting(q)
        if links:  # one row for each choice of q beside the atoms that it is bonded to
            for k, (w, i) in enumerate(links):
                bonds = corpus.directed.where(bond_column(query.bonds[i].expr)).select("mol_id", F.col("a").alias(f"q{w}"), F.col("b").alias(f"q{q}"))
                if last_semi and at == len(order) - 1:
                    added = bonds.join(added, ["mol_id", f"q{q}"])
                else:
                    out = out.join(bonds, ["mol_id", f"q{w}"] + ([f"q{q}"] if k else []))
        keys = ["mol_id", *(f"q{w}" for w, _ in links)] if last_semi and at == len(order) - 1 else ["mol_id", f"q{q}"] if links else ["mol_id"]
        apart = [p for p in mapped if not any(w == p for w, _ in links)]
        grouped = [p for p in mapped if query.atoms[q].group is not None and query.atoms[p].group is not None]
        if last_semi and at == len(order) - 1:
            added = added.select(*[F.col(c).alias(f"_{c}") for c in added.columns])
            on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(f"q{p}") != F.col(f"_q{q}") for p in apart]
            on += [(F.col(f"c{p}") == F.col(f"_c{q}")) == F.lit(query.atoms[p].group == query.atoms[q].group) for p in grouped]
            return out.join(added, reduce(Column.__and__, on), "left_semi")
        out = out.join(added, keys)
        for p in apart:
            out = out.where(F.col(f"q{p}") != F.col(f"q{q}"))
        for p in grouped:
            out = out.where((F.col(f"c{p}") == F.col(f"c{q}")) == F.lit(query.atoms[p].group == query.atoms[q].group))
        mapped.append(q)
    return out.select("mol_id", *[f"q{q}" for q in range(len(query.atoms))])


def matching(corpus: Corpus, query: Query) -> DataFrame:
    """(mol_id) of the molecules with an embedding; the last atom is only asked for, by a semi-join, so that its choices make no rows."""
    return embeddings(corpus, query, last_semi=True).select("mol_id").distinct()


def touched_bonds(corpus: Corpus, query: Query, found: DataFrame) -> DataFrame:
    """(mol_id, bond_id) of the bonds that the pattern's bonds lie on in any embedding."""
    ends = found.select("mol_id", F.explode(F.array(*[F.struct(F.col(f"q{b.a}").alias("a"), F.col(f"q{b.b}").alias("b")) for b in query.bonds])).alias("x")).select("mol_id", "x.a", "x.b").distinct()
    return ends.join(corpus.directed.select("mol_id", "a", "b", "bond_id"), ["mol_id", "a", "b"]).select("mol_id", "bond_id").distinct()
