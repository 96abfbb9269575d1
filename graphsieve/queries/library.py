"""Molecules put together by rule from scaffolds and substituents, and their atoms and bonds as SQL that knows no SMILES.

Of each scaffold: the SMILES with places 0 and 1 for substituents; its atoms as symbol (lower case: aromatic), hydrogens and charge; its
bonds as two atoms and a label; its rings as atoms; the component of each atom if there are several; the two atoms that carry
substituents. Of each substituent: the SMILES with the place of its bond, its atoms, its bonds, and its first atom's isotope. Molecule number
100 * scaffold + 10 * first + second substituent has the scaffold's atoms first, then those of the substituents.
"""

from __future__ import annotations

import re

from graphsieve.chem.elements import NUMBERS

SCAFFOLDS = (
    ("C{0}C{1}", "C3 C3", "01S", "", "", "0 1"),
    ("C{0}CO{1}", "C3 C2 O1", "01S 12S", "", "", "0 2"),
    ("C{0}C(=O)O{1}", "C3 C0 O0 O1", "01S 12D 13S", "", "", "0 3"),
    ("c1{0}cc{1}ccc1", "c1 c1 c1 c1 c1 c1", "01A 12A 23A 34A 45A 05A", "012345", "", "0 2"),
    ("c1{0}c{1}cccc1O", "c1 c1 c1 c1 c1 c0 O1", "01A 12A 23A 34A 45A 05A 56S", "012345", "", "0 1"),
    ("C{0}N{1}", "C3 N2", "01S", "", "", "0 1"),
    ("N{0}CC(=O)O{1}", "N2 C2 C0 O0 O1", "01S 12S 23D 24S", "", "", "0 4"),
    ("C1{0}CC1{1}", "C2 C2 C2", "01S 12S 02S", "012", "", "0 2"),
    ("c1{0}ccnc{1}c1", "c1 c1 c1 n0 c1 c1", "01A 12A 23A 34A 45A 05A", "012345", "", "0 4"),
    ("C{0}C(=O)N{1}", "C3 C0 O0 N2", "01S 12D 13S", "", "", "0 3"),
    ("C{0}=C{1}", "C2 C2", "01D", "", "", "0 1"),
    ("C{0}C#C{1}", "C3 C0 C1", "01S 12T", "", "", "0 2"),
    ("C{0}{1}C(=O)[O-].[Na+]", "C3 C0 O0 O0- Na0+", "01S 12D 13S", "", "00001", "0 0"),
    ("c1{0}cc{1}co1", "c1 c1 c1 c1 o0", "01A 12A 23A 34A 04A", "01234", "", "0 2"),
    ("N#CC{0}{1}", "N0 C0 C3", "01T 12S", "", "", "2 2"),
    ("c1{0}cc{1}c2ccccc2c1", "c1 c1 c1 c0 c1 c1 c1 c1 c0 c1", "01A 12A 23A 34A 45A 56A 67A 78A 38A 89A 09A", "012389 345678", "", "0 2"),
    ("C1{0}CCC{1}CC1", "C2 C2 C2 C2 C2 C2", "01S 12S 23S 34S 45S 05S", "012345", "", "0 3"),
    ("C1{0}CNCC{1}C1", "C2 C2 N1 C2 C2 C2", "01S 12S 23S 34S 45S 05S", "012345", "", "0 4"),
    ("[nH]1c{0}cc{1}c1", "n1 c1 c1 c1 c1", "01A 12A 23A 34A 04A", "01234", "", "1 3"),
    ("C1{0}CCC2CCC{1}CC2C1", "C2 C2 C2 C1 C2 C2 C2 C2 C1 C2", "01S 12S 23S 34S 45S 56S 67S 78S 38S 89S 09S", "012389 345678", "", "0 6"),
)
SUBSTITUENTS = (
    ("", "", "", 0), ("C{0}", "C3", "", 0), ("O{0}", "O1", "", 0), ("N{0}", "N2", "", 0), ("F{0}", "F0", "", 0), ("Cl{0}", "Cl0", "", 0), ("C{0}(=O)O", "C0 O0 O1", "01D 02S", 0), ("C{0}#N", "C0 N0", "01T", 0),
    ("[13CH3]{0}", "C3", "", 13), ("C{0}(=O)[O-]", "C0 O0 O0-", "01D 02S", 0),
)
SIZE = len(SCAFFOLDS) * len(SUBSTITUENTS) ** 2


def smiles(number: int) -> str:
    """Substituents are joined by ring closures over a dot, so that the order of atoms stays."""
    s, rest = divmod(number, len(SUBSTITUENTS) ** 2)
    parts, marks = [], []
    for k, u in enumerate(divmod(rest, len(SUBSTITUENTS))):
        marks.append(f"%9{k}" if u else "")
        if u:
            parts.append(SUBSTITUENTS[u][0].format(marks[-1]))
    return ".".join([SCAFFOLDS[s][0].format(*marks), *parts])


MOLECULES = tuple(smiles(n) for n in range(SIZE))


def _atoms(own: str) -> list[str]:
    out = []
    for text in own.split():
        symbol, h, charge = re.fullmatch(r"([A-Za-z]+)(\d)([+-]?)", text).groups()
        out.append(f"{NUMBERS[symbol.capitalize()]},{str(symbol.islower()).lower()},{charge or '+'}{1 if charge else 0},{h}")
    return out


def _values(rows: list[str]) -> str:
    return "(VALUES " + ",".join(f"({r})" for r in rows) + ")"


def tables() -> str:
    """SQL for the tables lib (lib, s, u, v), a (lib, atom, z, arom, charge, h, component, isotope, degree, rings, minring, ringbonds, hetero), b0 (lib, x, y, label) and b (lib, x, y, label, ring) from both sides, r0 (lib, ring, atom, size)."""
    sa, sb, sr, sn, ua, ub, un = [], [], [], [], [], [], []
    for s, (_, own, links, cycles, places, slots) in enumerate(SCAFFOLDS):
        atoms = _atoms(own)
        sa += [f"{s},{i},{x},{places[i] if places else 0}" for i, x in enumerate(atoms)]
        sb += [f"{s},{x},{y},'{label}'" for x, y, label in links.split()]
        sr += [f"{s},{k},{x},{len(r)}" for k, r in enumerate(cycles.split()) for x in r]
        sn.append(f"{s},{len(atoms)},{','.join(slots.split())}")
    for u, (_, own, links, isotope) in enumerate(SUBSTITUENTS):
        atoms = _atoms(own)
        ua += [f"{u},{i},{x},{isotope if i == 0 else 0}" for i, x in enumerate(atoms)]
        ub += [f"{u},{x},{y},'{label}'" for x, y, label in links.split()]
        un.append(f"{u},{len(atoms)}")
    n = len(SUBSTITUENTS)
    return f"""sa(s, atom, z, arom, charge, h, component) AS {_values(sa)}, sb(s, x, y, label) AS {_values(sb)}, sr(s, ring, atom, size) AS {_values(sr)}, sn(s, n, p, q) AS {_values(sn)},
ua(u, atom, z, arom, charge, h, isotope) AS {_values(ua)}, ub(u, x, y, label) AS {_values(ub)}, un(u, n) AS {_values(un)},
lib AS (SELECT s * {n * n} + i.u * {n} + j.u AS lib, s, i.u AS u, j.u AS v, sn.n AS m, i.n AS k, p, q FROM sn, un i, un j),
a0 AS (SELECT lib, atom, z, arom, charge, h - (u > 0 AND atom = p)::INT - (v > 0 AND atom = q)::INT AS h, component, 0 AS isotope FROM lib JOIN sa ON sa.s = lib.s
  UNION ALL SELECT lib, m + atom, z, arom, charge, h, 0, isotope FROM lib JOIN ua ON ua.u = lib.u
  UNION ALL SELECT lib, m + k + atom, z, arom, charge, h, 0, isotope FROM lib JOIN ua ON ua.u = lib.v),
b0 AS (SELECT lib, x, y, label FROM lib JOIN sb ON sb.s = lib.s
  UNION ALL SELECT lib, m + x, m + y, label FROM lib JOIN ub ON ub.u = lib.u UNION ALL SELECT lib, m + k + x, m + k + y, label FROM lib JOIN ub ON ub.u = lib.v
  UNION ALL SELECT lib, p, m, 'S' FROM lib WHERE u > 0 UNION ALL SELECT lib, q, m + k, 'S' FROM lib WHERE v > 0),
r0 AS (SELECT lib, ring, atom, size FROM lib JOIN sr ON sr.s = lib.s),
rb AS (SELECT DISTINCT b0.lib, x, y FROM b0 JOIN r0 i ON i.lib = b0.lib AND i.atom = x JOIN r0 j ON j.lib = i.lib AND j.ring = i.ring AND j.atom = y),
b1 AS (SELECT b0.*, rb.lib IS NOT NULL AS ring FROM b0 LEFT JOIN rb ON rb.lib = b0.lib AND rb.x = b0.x AND rb.y = b0.y),
b AS (SELECT lib, x, y, label, ring FROM b1 UNION ALL SELECT lib, y, x, label, ring FROM b1),
near AS (SELECT b.lib, x AS atom, count(*) AS degree, count(*) FILTER (b.ring) AS ringbonds, count(*) FILTER (o.z NOT IN (1, 6)) AS hetero FROM b JOIN a0 o ON o.lib = b.lib AND o.atom = b.y GROUP BY ALL),
inside AS (SELECT lib, atom, count(*) AS rings, min(size) AS minring FROM r0 GROUP BY ALL),
a AS (SELECT a0.*, coalesce(degree, 0) AS degree, coalesce(rings, 0) AS rings, coalesce(minring, 0) AS minring, coalesce(ringbonds, 0) AS ringbonds, coalesce(hetero, 0) AS hetero
  FROM a0 LEFT JOIN near USING (lib, atom) LEFT JOIN inside USING (lib, atom))"""
