"""What share of atoms a predicate is expected to let through, from counts over atoms; it decides where a pattern is begun, never what it matches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of atoms by property and value in the molecules of queries.library, rounded; `measured` takes them from a corpus.
USUAL: dict[tuple[str, int], float] = {
    ("z", 6): 0.72, ("z", 7): 0.08, ("z", 8): 0.13, ("z", 9): 0.03, ("z", 16): 0.01, ("z", 17): 0.02, ("aromatic", 1): 0.4, ("degree", 1): 0.33, ("degree", 2): 0.45, ("degree", 3): 0.21, ("total_h", 0): 0.4,
    ("total_h", 1): 0.35, ("total_h", 2): 0.15, ("total_h", 3): 0.1, ("charge", 0): 0.97, ("in_ring", 1): 0.6,
}
PROPERTIES = ("z", "aromatic", "degree", "total_h", "charge", "in_ring", "hyb", "ring_count", "min_ring", "ring_bonds", "connectivity", "valence", "hetero")
_UNKNOWN = 0.02


def measured(atoms: DataFrame) -> dict[tuple[str, int], float]:
    """Shares by property and value of an atoms table; one row for each value that occurs comes to the driver."""
    values = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).cast("int").alias("v")) for p in PROPERTIES])).alias("x")
    rows = atoms.where("NOT hidden_h").select(values).groupBy("x.p", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()
    total = max(1, sum(r.n for r in rows) // len(PROPERTIES))
    return {(r.p, r.v): r.n / total for r in rows if r.v is not None}


def share(node: tuple, known: Mapping[tuple[str, int], float] = USUAL) -> float:
    """Expected share of atoms that an expression accepts, as if its primitives were independent."""
    op, *rest = node
    if op == "not":
        return 1 - share(rest[0], known)
    if op in ("and", "low"):
        out = 1.0
        for x in rest:
            out *= share(x, known)
        return out
    if op == "or":
        out = 1.0
        for x in rest:
            out *= 1 - share(x, known)
        return 1 - out

    def of(name: str, value: int) -> float:
        return known.get((name, value), _UNKNOWN)

    value = rest[0] if rest else None
    if op in ("any", "chiral"):
        return 1.0
    if op in ("aromatic", "aliphatic"):
        return of("aromatic", 1) if op == "aromatic" else 1 - of("aromatic", 1)
    if op == "symbol":
        return of("z", value[0]) * share(("aromatic" if value[1] else "aliphatic", None), known)
    if op == "number":
        return of("z", value)
    if op in ("isotope", "mass"):
        return _UNKNOWN if op == "isotope" or value else 1.0
    if op == "charge":
        return of("charge", value)
    if op == "recursive":
        return 0.5 * share(value.atoms[0].expr, known)
    if value is None:
        return of("in_ring", 1) if op in ("ring_count", "min_ring", "ring_bonds") else of(op, 1)
    low, high = value
    if high is None:
        return max(_UNKNOWN, 1 - sum(of(op, v) for v in range(low or 0) if (op, v) in known))
    return min(1.0, sum(of(op, v) for v in range(low or 0, min(high, (low or 0) + 64) + 1)))
