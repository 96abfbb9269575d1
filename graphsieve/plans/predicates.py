"""Atom and bond expressions as columns over the atoms and bonds tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphsieve.plans.kernel import STATES, bond_states
from graphsieve.smarts.query import RING_KINDS


def numeric(column: Column, kind: str, span: tuple | None) -> Column:
    if span is None:
        return column > 0 if kind in RING_KINDS else column == 1
    low, high = span
    if low == high:
        return column == low
    parts = [column >= low] if low is not None else []
    parts += [column <= high] if high is not None else []
    return reduce(Column.__and__, parts)


def atom_column(node: tuple, slots: dict[int, Column]) -> Column:
    """A boolean column that is never null; slots: the column that answers each recursive pattern, by its id()."""
    op, *rest = node
    if op == "not":
        return ~atom_column(rest[0], slots)
    if op in ("and", "low", "or"):
        return reduce(Column.__or__ if op == "or" else Column.__and__, [atom_column(x, slots) for x in rest])
    value = rest[0]
    c = F.col
    if op in ("any", "chiral"):
        return F.lit(True)
    if op == "recursive":
        return F.coalesce(slots[id(value)], F.lit(False))
    if op == "mass":
        return c("isotope").isNull() if value == 0 else F.coalesce(c("isotope") == value, F.lit(False))
    made = {
        "aliphatic": lambda: c("z").isNotNull() & ~c("aromatic"),
        "aromatic": lambda: c("z").isNotNull() & c("aromatic"),
        "symbol": lambda: (c("z") == value[0]) & (c("aromatic") == F.lit(value[1])),
        "isotope": lambda: (c("isotope") == value[0]) & (c("z") == value[1]) & (c("aromatic") == F.lit(value[2])),
        "number": lambda: c("z") == value,
        "charge": lambda: c("charge") == value,
    }
    return F.coalesce(made[op]() if op in made else numeric(c(op), op, value), F.lit(False))


def bond_column(expr: tuple | None) -> Column:
    states = bond_states(expr)
    if states == STATES:
        return F.lit(True)
    both = sorted(label for label, ring in states if ring and (label, False) in states)
    only = [sorted(label for label, ring in states if ring is side and (label, not side) not in states) for side in (True, False)]
    parts = [F.col("label").isin(both)] if both else []
    parts += [F.col("in_ring") & F.col("label").isin(only[0])] if only[0] else []
    parts += [~F.col("in_ring") & F.col("label").isin(only[1])] if only[1] else []
    return reduce(Column.__or__, parts) if parts else F.lit(False)
