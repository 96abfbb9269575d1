"""Patterns against a batch of molecules at once, as array operations.

Every predicate is a mask over all atoms of the batch, computed once whatever number of patterns uses it. Embeddings grow as tables of
atom numbers, a column for each pattern atom: a step repeats each row for the neighbours of a mapped atom and drops
what a mask, a bond or an earlier atom rules out. The rarest atom by the masks' counts is first. Tables are cut into pieces of MOST_ROWS
rows, which are finished one after the other, so that memory is bounded by the pattern's size; where only existence counts, what
belongs to molecules that have matched is dropped before each step.

Parts of a pattern that are not connected are matched by themselves. Molecules in which each part has an embedding are then settled
one by one by the kernel's rules for joint sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from graphsieve.chem.smiles import ANY, AROMATIC, DOUBLE, DOWN, SINGLE, TRIPLE, UP
from graphsieve.plans import kernel
from graphsieve.plans.kernel import Matcher, bond_states
from graphsieve.smarts import edit
from graphsieve.smarts.query import RING_KINDS, to_smarts

MOST_ROWS = 1 << 17
#: Atoms of a part from which its existence is looked for from one atom of each molecule first.
WAVES_FROM = 4
LABELS = (SINGLE, DOUBLE, TRIPLE, AROMATIC, UP, DOWN, ANY)
#: Types of the packed columns; an atom has so many values of each as COPIES says.
ATOM_TYPES = {
    "z": "<i2", "isotope": "<i2", "aromatic": "u1", "charge": "<i2", "degree": "<i2", "connectivity": "<i2", "implicit_h": "<i2", "total_h": "<i2", "valence": "<i2", "hyb": "u1", "hetero": "<i2",
    "aliph_hetero": "<i2", "ring_count": "<i2", "min_ring": "<i2", "ring_bonds": "<i2", "in_ring": "u1", "component": "<i4", "hidden_h": "u1", "chiral": "u1", "around": "<i4",
}
BOND_TYPES = {"a": "<i4", "b": "<i4", "state": "u1", "sides": "<i4"}
COPIES = {"around": 4, "sides": 3}
_TURNS = {"@": 1, "@TH1": 1, "@@": 2, "@TH2": 2}


def packed(molecules: list) -> dict[str, pa.Array]:
    """The packed columns of molecules, atom_* and bond_*, one binary value each; numbers that are None are -1, an isotope 0. A molecule that is None has no atoms."""
    known = [m for m in molecules if m is not None]
    atoms = {k: [v for m in known for v in getattr(m, k)] for k in ATOM_TYPES if k not in ("z", "isotope", "chiral", "around")}
    atoms["z"] = [-1 if z is None else z for m in known for z in m.z]
    atoms["isotope"] = [x or 0 for m in known for x in m.isotope]
    atoms["chiral"] = [_TURNS.get(x.chiral, 0) for m in known for x in m.graph.atoms]
    atoms["around"] = [v for m in known for o in m.graph.order for v in (o if len(o) == 4 else [*o, -1] if len(o) == 3 else (-2, -2, -2, -2))]
    state = {(label, ring): 2 * i + ring for i, label in enumerate(LABELS) for ring in (0, 1)}
    bonds = {k: [getattr(x, k) for m in known for x in m.graph.bonds] for k in "ab"}
    bonds["state"] = [state[label, int(ring)] for m in known for label, ring in zip(m.label, m.bond_ring, strict=True)]
    bonds["sides"] = [v for m in known for s in m.stereo for v in ((-1, -1, -1) if s is None else (s[0], s[1], int(s[2])))]
    out = {}
    for prefix, columns, types, sizes in (("atom", atoms, ATOM_TYPES, [len(m) if m is not None else 0 for m in molecules]), ("bond", bonds, BOND_TYPES, [len(m.label) if m is not None else 0 for m in molecules])):
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for name, kind in types.items():
            data = np.array(columns[name], kind)
            where = (ends * (COPIES.get(name, 1) * data.itemsize)).astype(np.int32)
            out[f"{prefix}_{name}"] = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(where), pa.py_buffer(data)])
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a binary column as one array, and where each value begins."""
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


class Batch:
    """Molecules whose atoms are numbered through. mol: the molecule of each atom; first: each molecule's first atom."""

    def __init__(self, columns: dict[str, pa.Array]):
        self.columns = columns
        self.fields: dict[str, np.ndarray] = {}
        self.masks: dict[str, np.ndarray] = {}
        _, at = _bytes(columns["atom_hidden_h"])
        self.first = at.astype(np.int64)
        self.mol = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.size, self.atoms = len(at) - 1, int(at[-1])
        self.shown = self.field("hidden_h") == 0
        self._arcs()

    def field(self, name: str) -> np.ndarray:
        if name not in self.fields:
            data, _ = _bytes(self.columns[f"atom_{name}"])
            self.fields[name] = np.frombuffer(data.tobytes(), ATOM_TYPES[name]).reshape(self.atoms, -1) if name in COPIES else np.frombuffer(data.tobytes(), ATOM_TYPES[name])
        return self.fields[name]

    def bond_field(self, name: str) -> np.ndarray:
        data, _ = _bytes(self.columns[f"bond_{name}"])
        return np.frombuffer(data.tobytes(), BOND_TYPES[name]).reshape(-1, COPIES.get(name, 1))

    def _arcs(self) -> None:
        """Bonds from both sides, by first and second atom: begin, to, state and bond; key finds the one between two atoms."""
        _, at = _bytes(self.columns["bond_state"])
        self.bond_mol = np.repeat(np.arange(self.size), np.diff(at))
        self.bond_first = at.astype(np.int64)
        base = self.first[self.bond_mol]
        a, b = (self.bond_field(x)[:, 0] + base for x in "ab")
        state = self.bond_field("state")[:, 0]
        key = np.concatenate([a * self.atoms + b, b * self.atoms + a])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.to = self.key % max(self.atoms, 1)
        self.state = np.concatenate([state, state])[order]
        self.bond = np.concatenate([np.arange(len(a))] * 2)[order]
        self.begin = np.searchsorted(self.key, np.arange(self.atoms + 1) * self.atoms)
        self.a = a

    def arc(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of the arc from x to y, -1 where there is none."""
        if not len(self.key):
            return np.full(len(x), -1)
        wanted = x * self.atoms + y
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, -1)


class Program:
    """A pattern made ready for batches."""

    def __init__(self, matcher: Matcher):
        self.matcher, self.query = matcher, matcher.query
        self.text = to_smarts(matcher.query)
        self.inner: dict[int, Program] = {}
        self.accepts = []
        for bond in self.query.bonds:
            states = bond_states(bond.expr)
            self.accepts.append(np.array([(label, bool(ring)) in states for label in LABELS for ring in (0, 1)]))
        # What lies on a cycle of the pattern lies in a ring of the molecule.
        cyclic = [b for i, b in enumerate(self.query.bonds) if edit.is_cycle_edge(self.query, i)]
        self.in_ring = {v for b in cyclic for v in (b.a, b.b)}
        for i, bond in enumerate(self.query.bonds):
            if any(bond is b for b in cyclic):
                self.accepts[i] &= np.arange(2 * len(LABELS)) % 2 == 1
        self.names = frozenset(_fields(self))

    def mask(self, batch: Batch, node: tuple) -> np.ndarray:
        """Atoms that an expression accepts, hidden hydrogens aside; kept in the batch by the expression."""
        op, *rest = node
        if op == "recursive":
            key = self._recursive(rest[0]).text
        else:
            key = repr(node) if op not in ("not", "and", "low", "or") else None
        if key is not None and key in batch.masks:
            return batch.masks[key]
        if op == "not":
            out = ~self.mask(batch, rest[0])
        elif op in ("and", "low"):
            out = self.mask(batch, rest[0])
            for x in rest[1:]:
                out = out & self.mask(batch, x)
        elif op == "or":
            out = self.mask(batch, rest[0])
            for x in rest[1:]:
                out = out | self.mask(batch, x)
        elif op == "recursive":
            out = self._recursive(rest[0]).anchored(batch)
        else:
            out = _primitive(batch, op, rest[0])
        if key is not None:
            batch.masks[key] = out
        return out

    def _recursive(self, query) -> Program:
        if id(query) not in self.inner:
            self.inner[id(query)] = Program(Matcher(query))
        return self.inner[id(query)]

    def candidates(self, batch: Batch) -> list[np.ndarray]:
        out = []
        for q, atom in enumerate(self.query.atoms):
            links = len(self.matcher.near[q])
            fits = self.mask(batch, atom.expr) & batch.shown
            if q in self.in_ring:
                fits &= batch.field("in_ring") == 1
            out.append(fits & (batch.field("degree") >= links) if links > 1 else fits)
        return out

    def tables(self, batch: Batch, part: int, masks: list[np.ndarray], anchored: bool = False, done: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Pieces of the table of a part's embeddings, columns in the order of its atoms. done: by molecule, or anchored by atom, what needs no more; it may be set meanwhile."""
        own = self.matcher.parts[part]
        sizes = [float(m.sum()) for m in masks]
        order = kernel.by_rarity(own, self.matcher.near, sizes, own[0] if anchored else None)
        column = {q: k for k, q in enumerate(order)}
        back = [order.index(q) for q in own]
        steps = []
        for k, q in enumerate(order[1:], 1):
            links = [(column[w], i) for w, i in self.matcher.near[q] if column.get(w, k) < k]
            steps.append((q, links, [p for p in range(k) if p not in {c for c, _ in links}]))
        start = np.flatnonzero(masks[order[0]])
        todo = [start.reshape(-1, 1)]
        if done is not None and not anchored and len(order) >= WAVES_FROM and len(start):
            # Each molecule's first atom goes first, as where it leads to an embedding the others need not be tried.
            mol = batch.mol[start]
            new = np.flatnonzero(np.concatenate([[True], mol[1:] != mol[:-1]]))
            place = np.arange(len(start)) - np.repeat(new, np.diff(np.append(new, len(start))))
            todo = [start[(place >= a) & (place < b)].reshape(-1, 1) for a, b in ((3, len(start)), (1, 3), (0, 1))]
        while todo:
            rows = todo.pop()
            if len(rows) > MOST_ROWS:
                todo += [rows[a : a + MOST_ROWS] for a in range(0, len(rows), MOST_ROWS)][::-1]
                continue
            if done is not None:
                rows = rows[~done[rows[:, 0] if anchored else batch.mol[rows[:, 0]]]]
            if not len(rows):
                continue
            if rows.shape[1] == len(order):
                rows = rows[:, back]
                rows = self._turned(batch, own, rows)
                if len(rows):
                    yield rows
                continue
            q, links, apart = steps[rows.shape[1] - 1]
            todo.append(self._step(batch, rows, masks[q], links, apart))

    def _step(self, batch: Batch, rows: np.ndarray, mask: np.ndarray, links: list, apart: list[int]) -> np.ndarray:
        """Rows with one more column, an atom of the mask that is bonded to the linked columns as asked for and is none of the others."""
        (near, i), *others = links
        v = rows[:, near]
        many = batch.begin[v + 1] - batch.begin[v]
        line = np.repeat(np.arange(len(rows)), many)
        arc = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(batch.begin[v], many)
        to = batch.to[arc]
        keep = mask[to] & self.accepts[i][batch.state[arc]]
        line, to = line[keep], to[keep]
        for c, i in others:
            arc = batch.arc(rows[line, c], to)
            keep = (arc >= 0) & self.accepts[i][batch.state[arc]]
            line, to = line[keep], to[keep]
        keep = np.ones(len(to), bool)
        for c in apart:
            keep &= rows[line, c] != to
        return np.column_stack([rows[line[keep]], to[keep]])

    def _turned(self, batch: Batch, own: list[int], rows: np.ndarray) -> np.ndarray:
        """Rows whose tetrahedral turns and double bond sides are those of the pattern."""
        column = {q: k for k, q in enumerate(own)}
        for q, order, turn in self.matcher.centres:
            if q not in column or not len(rows):
                continue
            v = rows[:, column[q]]
            chiral, base = batch.field("chiral")[v], batch.first[batch.mol[v]]
            held = batch.field("around")[v].astype(np.int64)
            target = np.where(held >= 0, held + base[:, None], held)
            mapped = np.stack([rows[:, column[w]] if w >= 0 else np.full(len(rows), -1) for w in order], axis=1)
            if -1 in order:
                at = order.index(-1)
                others = np.delete(mapped, at, axis=1)
                rest = ~(target[:, :, None] == others[:, None, :]).any(axis=2)
                mapped[:, at] = np.where(rest.sum(axis=1) == 1, target[np.arange(len(rows)), rest.argmax(axis=1)], -3)
            same = mapped[:, :, None] == target[:, None, :]
            good = (chiral > 0) & (same.sum(axis=2) == 1).all(axis=1) & (same.sum(axis=1) == 1).all(axis=1)
            place = same.argmax(axis=2)
            odd = sum((place[:, i] > place[:, j]).astype(int) for i in range(4) for j in range(i + 1, 4)) % 2 == 1
            rows = rows[good & ((chiral == 1) == ((turn == 1) != odd))]
        for a, b, left, right, alike in self.matcher.doubles:
            if a not in column or not len(rows):
                continue
            x, y = rows[:, column[a]], rows[:, column[b]]
            bond = batch.bond[batch.arc(x, y)]
            known = batch.bond_field("sides")[bond].astype(np.int64)
            base = batch.first[batch.mol[x]]
            flip = batch.a[bond] != x
            ref_left, ref_right = np.where(flip, known[:, 1], known[:, 0]) + base, np.where(flip, known[:, 0], known[:, 1]) + base
            wanted = alike != (rows[:, column[left]] != ref_left)
            there = (known[:, 2] == 1) != (rows[:, column[right]] != ref_right)
            rows = rows[(known[:, 2] >= 0) & (wanted == there)]
        return rows

    def anchored(self, batch: Batch) -> np.ndarray:
        """Atoms that the pattern's first atom can be, in any embedding."""
        masks = self.candidates(batch)
        if len(self.matcher.parts) > 1:
            return self._anchored_parts(batch, masks)
        if len(masks) == 1 and not self.matcher.centres:
            return masks[0]
        done = np.zeros(batch.atoms, bool)
        for rows in self.tables(batch, 0, masks, True, done):
            done[rows[:, 0]] = True
        return done

    def _anchored_parts(self, batch: Batch, masks: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(batch.atoms, bool)
        for k, options in self._settled(batch, *self._part_tables(batch, masks)):
            base = int(batch.first[k])
            for v in {to[0] for to in options[0]}:
                out[base + v] = kernel.possible([[to for to in options[0] if to[0] == v], *options[1:]], *self._rules(batch, k), 0, {})
        return out

    def _part_tables(self, batch: Batch, masks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Molecules in which each part has an embedding, and the table of each part, which is sorted by molecule."""
        m = self.matcher
        alive = np.ones(batch.size, bool)
        found: list = [None] * len(m.parts)
        for k in sorted(range(len(m.parts)), key=lambda k: min(masks[q].sum() for q in m.parts[k])):
            rows = list(self.tables(batch, k, [x & alive[batch.mol] for x in masks]))
            found[k] = np.concatenate(rows) if rows else np.zeros((0, len(m.parts[k])), np.int64)
            alive &= np.bincount(batch.mol[found[k][:, 0]], minlength=batch.size) > 0
        return alive & self._apart(batch, found), found

    def _apart(self, batch: Batch, found: list[np.ndarray]) -> np.ndarray:
        """Molecules with as many components that hold parts of a component group as there are such groups."""
        groups = [g for g in self.matcher.groups if g is not None]
        if len(set(groups)) < 2:
            return np.ones(batch.size, bool)
        atoms = np.concatenate([table[:, 0] for table, g in zip(found, self.matcher.groups, strict=True) if g is not None])
        component = batch.field("component").astype(np.int64)
        wide = int(component.max()) + 1 if len(component) else 1
        seen = np.zeros(batch.size * wide, bool)
        seen[batch.mol[atoms] * wide + component[atoms]] = True
        return seen.reshape(batch.size, wide).sum(axis=1) >= len(set(groups))

    def _settled(self, batch: Batch, alive: np.ndarray, found: list[np.ndarray]) -> Iterator[tuple[int, list[list[list[int]]]]]:
        """(molecule, embeddings of each part) one by one, with the molecule's own atom numbers as the kernel has them."""
        n = len(self.query.atoms)
        edges = [np.searchsorted(batch.mol[table[:, 0]], np.arange(batch.size + 1)) for table in found]
        for k in np.flatnonzero(alive).tolist():
            options = []
            for own, table, edge in zip(self.matcher.parts, found, edges, strict=True):
                wide = np.full((edge[k + 1] - edge[k], n), -1, np.int64)
                wide[:, own] = table[edge[k] : edge[k + 1]] - batch.first[k]
                options.append(wide.tolist())
            yield k, options

    def _rules(self, batch: Batch, k: int) -> tuple:
        return self.matcher.parts, self.matcher.groups, batch.field("component")[batch.first[k] : batch.first[k + 1]].tolist()

    def _at_once(self, batch: Batch, alive: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """Molecules in which the first embedding of each part that gets on with those taken before makes a joint one."""
        groups, out = self.matcher.groups, alive.copy()
        taken = np.full((batch.size, 0), -1)
        places: list[tuple[int, np.ndarray]] = []
        for k in sorted(range(len(found)), key=lambda k: len(found[k])):
            table, mol = found[k], batch.mol[found[k][:, 0]]
            good = out[mol]
            for c in range(table.shape[1]):
                good &= ~(taken[mol] == table[:, c : c + 1]).any(axis=1)
            place = batch.field("component")[table[:, 0]]
            if groups[k] is not None:
                for group, where in places:
                    good &= (where[mol] == place) == (group == groups[k])
            lines = np.flatnonzero(good)
            rows = lines[np.concatenate([[True], mol[lines[1:]] != mol[lines[:-1]]])] if len(lines) else lines
            which = mol[rows]
            there = np.zeros(batch.size, bool)
            there[which] = True
            out &= there
            more = np.full((batch.size, table.shape[1]), -1)
            more[which] = table[rows]
            taken = np.concatenate([taken, more], axis=1)
            if groups[k] is not None:
                where = np.full(batch.size, -1)
                where[which] = place[rows]
                places.append((groups[k], where))
        return out

    def exists(self, batch: Batch, only: np.ndarray | None = None) -> np.ndarray:
        """Whether each molecule, of these the ones in `only`, has an embedding."""
        masks = self.candidates(batch)
        if only is not None:
            masks = [m & only[batch.mol] for m in masks]
        done = np.zeros(batch.size, bool)
        if len(self.matcher.parts) > 1:
            alive, found = self._part_tables(batch, masks)
            done = self._at_once(batch, alive, found)
            for k, options in self._settled(batch, alive & ~done, found):
                done[k] = kernel.possible(options, *self._rules(batch, k), 0, {})
        elif len(masks) == 1 and not self.matcher.centres:
            done[batch.mol[masks[0]]] = True
        else:
            for rows in self.tables(batch, 0, masks, done=done):
                done[batch.mol[rows[:, 0]]] = True
        return done

    def least(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(molecules, embeddings): for each set of atoms of a molecule the least embedding, ordered by molecule and sorted set; atoms are the molecule's own."""
        masks, n = self.candidates(batch), len(self.query.atoms)
        if len(self.matcher.parts) > 1:
            mols, found = [], []
            for k, options in self._settled(batch, *self._part_tables(batch, masks)):
                least = sorted(kernel.together(options, *self._rules(batch, k)).values(), key=sorted)
                mols += [k] * len(least)
                found += least
            return np.array(mols, np.int64), np.array(found, np.int64).reshape(-1, n)
        held = np.zeros((0, n), np.int64)
        waiting: list[np.ndarray] = []
        for rows in self.tables(batch, 0, masks):
            waiting.append(rows)
            if sum(map(len, waiting)) > 8 * MOST_ROWS:
                held, waiting = _least_rows(np.concatenate([held, *waiting])), []
        held = _least_rows(np.concatenate([held, *waiting]))
        mol = batch.mol[held[:, 0]] if len(held) else np.zeros(0, np.int64)
        return mol, held - batch.first[mol][:, None] if len(held) else held

    def counts(self, batch: Batch) -> np.ndarray:
        """Number of distinct sets of atoms of each molecule."""
        if len(self.query.atoms) == 1 and not self.matcher.centres:
            return np.bincount(batch.mol[self.candidates(batch)[0]], minlength=batch.size)
        if len(self.query.atoms) == len(self.matcher.parts) == 2:
            return self._pair_counts(batch, *self.candidates(batch))
        return np.bincount(self.least(batch)[0], minlength=batch.size)

    def _pair_counts(self, batch: Batch, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sets of an atom that fits the first part and another that fits the second; pairs of which both fit both count once."""

        def sets(place: np.ndarray, size: int) -> np.ndarray:
            first, second, both = (np.bincount(place[x], minlength=size) for x in (a, b, a & b))
            return first * second - both - both * (both - 1) // 2

        whole, groups = sets(batch.mol, batch.size), self.matcher.groups
        if None in groups or not batch.atoms:
            return whole
        component = batch.field("component").astype(np.int64)
        wide = int(component.max()) + 1
        within = sets(batch.mol * wide + component, batch.size * wide).reshape(batch.size, wide).sum(axis=1)
        return within if groups[0] == groups[1] else whole - within

    def coverage(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Whether each molecule has an embedding, and the share of its atoms and bonds that any touches."""
        masks = self.candidates(batch)
        atoms, bonds = np.zeros(batch.atoms, bool), np.zeros(len(batch.bond_mol), bool)
        m = self.matcher

        def touch(rows: np.ndarray, own: list[int]) -> None:
            column = {q: k for k, q in enumerate(own)}
            atoms[rows.ravel()] = True
            for b in self.query.bonds:
                if b.a in column:
                    bonds[batch.bond[batch.arc(rows[:, column[b.a]], rows[:, column[b.b]])]] = True

        if len(m.parts) == 1:
            for rows in self.tables(batch, 0, masks):
                touch(rows, m.parts[0])
        else:
            for k, options in self._settled(batch, *self._part_tables(batch, masks)):
                for to in kernel.taking_part(options, *self._rules(batch, k)):
                    own = [q for q, v in enumerate(to) if v >= 0]
                    touch(np.array([[to[q] for q in own]]) + batch.first[k], own)
        touched = np.bincount(batch.mol[atoms], minlength=batch.size)
        matched = touched > 0
        touched = touched + np.bincount(batch.bond_mol[bonds], minlength=batch.size)
        size = np.diff(batch.first) + np.diff(batch.bond_first)
        return matched, touched / np.maximum(size, 1)


def _least_rows(rows: np.ndarray) -> np.ndarray:
    """Of rows with the same set of numbers the least, in the order of the sorted sets."""
    if not len(rows):
        return rows
    sets = np.sort(rows, axis=1)
    order = np.lexsort([*rows.T[::-1], *sets.T[::-1]])
    sets, rows = sets[order], rows[order]
    new = np.concatenate([[True], (sets[1:] != sets[:-1]).any(axis=1)])
    return rows[new]


def _primitive(batch: Batch, op: str, value) -> np.ndarray:
    f = batch.field
    if op in ("any", "chiral"):
        return np.ones(batch.atoms, bool)
    if op in ("aliphatic", "aromatic"):
        return (f("z") >= 0) & (f("aromatic") == (op == "aromatic"))
    if op == "symbol":
        return (f("z") == value[0]) & (f("aromatic") == int(value[1]))
    if op == "isotope":
        return (f("isotope") == value[0]) & (f("z") == value[1]) & (f("aromatic") == int(value[2]))
    if op == "mass":
        return f("isotope") == value
    if op in ("number", "charge"):
        return f("z" if op == "number" else op) == value
    low, high = value if value is not None else (1, None) if op in RING_KINDS else (1, 1)
    x = f(op)
    out = x >= (low or 0)
    return out if high is None else out & (x <= high)


def _fields(program: Program) -> set[str]:
    """Packed columns that a pattern reads."""
    out = {"atom_hidden_h", "bond_a", "bond_b", "bond_state"}
    if len(program.matcher.parts) > 1:  # for component groups and joint sets
        out.add("atom_component")
    if program.query.bonds:
        out.add("atom_degree")
    if program.in_ring:
        out.add("atom_in_ring")
    if program.matcher.centres:
        out |= {"atom_chiral", "atom_around"}
    if program.matcher.doubles:
        out.add("bond_sides")
    needs = {"aliphatic": ("z", "aromatic"), "aromatic": ("z", "aromatic"), "symbol": ("z", "aromatic"), "isotope": ("z", "aromatic", "isotope"), "mass": ("isotope",), "number": ("z",), "any": (), "chiral": ()}
    for atom in program.query.atoms:
        for node, _ in kernel.primitives(atom.expr):
            if node[0] == "recursive":
                out |= _fields(program._recursive(node[1]))
            else:
                out |= {f"atom_{x}" for x in needs.get(node[0], (node[0],))}
    return out
