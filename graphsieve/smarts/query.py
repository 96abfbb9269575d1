"""Patterns: their trees and graph, SMARTS text to pattern, and pattern to text.

An expression is a nested tuple: ("not", x), ("and" | "or" | "low", x, y, ...) with "low" for the loose semicolon, or a
primitive (kind, value). The loosest operator is ; then , then & or nothing, then !.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from graphsieve.chem.elements import NUMBERS, SYMBOLS

#: Symbols that may stand without brackets, and aromatic ones within.
BARE = frozenset(("Cl", "Br", "Na", "Ca", "Sc", "Co", "As", "Nb", "In", "Sn", "Sb", "Cs", "Ba", "Os", "Pb", "Po", "Ac", "Pa", "Np", "No", "Cn", "B", "C", "N", "O", "P", "S", "F", "I"))
AROMATIC_SYMBOLS = {"b": 5, "c": 6, "n": 7, "o": 8, "p": 15, "s": 16, "as": 33, "se": 34}
#: Numeric primitives by letter; the first ones mean exactly 1 without a number, RING_KINDS more than 0, ^ needs one.
NUMERIC = {"D": "degree", "X": "connectivity", "v": "valence", "h": "implicit_h", "z": "hetero", "Z": "aliph_hetero", "R": "ring_count", "r": "min_ring", "x": "ring_bonds", "^": "hyb", "H": "total_h"}
RING_KINDS = ("ring_count", "min_ring", "ring_bonds")
LETTER = {v: k for k, v in NUMERIC.items()}
CHIRAL_MOST = {"TH": 2, "AL": 2, "SP": 3, "TB": 20, "OH": 30}
BOND_SIGNS = "-=#:~@/\\"
LEVELS = (("low", ";"), ("or", ","), ("and", "&"))


class SmartsError(ValueError):
    def __init__(self, code: str, at: int = 0):
        super().__init__(code)
        self.code, self.at = code, at


@dataclass
class QueryAtom:
    expr: tuple
    component: int = 0
    group: int | None = None
    atom_map: int | None = None
    bare: bool = False


@dataclass
class QueryBond:
    a: int
    b: int
    expr: tuple | None = None  # None: not written


@dataclass
class Query:
    atoms: list[QueryAtom] = field(default_factory=list)
    bonds: list[QueryBond] = field(default_factory=list)
    #: Of each atom its neighbours in written order, -1 for a hydrogen in its bracket; for chirality.
    order: list[list[int]] = field(default_factory=list)

    @property
    def components(self) -> int:
        return len({a.component for a in self.atoms})

    def neighbours(self) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in self.atoms]
        for i, bond in enumerate(self.bonds):
            out[bond.a].append((bond.b, i))
            out[bond.b].append((bond.a, i))
        return out


def join(op: str, parts: list[tuple]) -> tuple:
    return parts[0] if len(parts) == 1 else (op, *parts)


def primitives(expr: tuple | None):
    """All primitives of a tree, in text order, with whether each stands under an odd number of negations."""
    todo = [(expr, False)] if expr else []
    while todo:
        node, negated = todo.pop()
        if node[0] == "not":
            todo.append((node[1], not negated))
        elif node[0] in ("and", "or", "low"):
            todo += [(x, negated) for x in reversed(node[1:])]
        else:
            yield node, negated


class _Bracket:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, code: str = "unexpected_character") -> SmartsError:
        return SmartsError("unexpected_end_of_input" if code == "unexpected_character" and self.at >= len(self.text) else code, self.at)

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def parse(self) -> tuple[tuple, int | None]:
        if not self.text:
            raise SmartsError("unexpected_end_of_input")
        tree = self.level(0)
        atom_map = None
        if self.peek() == ":":
            self.at += 1
            atom_map = self.number()
            if atom_map is None:
                raise self.fail()
        if self.at < len(self.text):
            raise self.fail()
        return tree, atom_map

    def level(self, depth: int) -> tuple:
        op, sign = LEVELS[depth]
        lower = (lambda: self.level(depth + 1)) if depth < 2 else self.negated
        parts = [lower()]
        while (c := self.peek()) and (c == sign or op == "and" and c not in ";,:"):
            if c == sign:
                self.at += 1
            parts.append(lower())
        return join(op, parts)

    def negated(self) -> tuple:
        odd = False
        while self.peek() == "!":
            self.at += 1
            odd = not odd
        start = self.at == 0
        tree = self.primitive(start)
        return ("not", tree) if odd else tree

    def number(self) -> int | None:
        m = re.compile(r"\d+").match(self.text, self.at)
        if not m:
            return None
        if int(m[0]) > 65535:
            raise self.fail("unsupported_atom_primitive")
        self.at = m.end()
        return int(m[0])

    def span(self) -> tuple[int | None, int | None] | None:
        """(least, most); None where no number is written."""
        if self.peek() != "{":
            n = self.number()
            return None if n is None else (n, n)
        self.at += 1
        low = self.number()
        ranged = self.peek() == "-"
        self.at += ranged
        high = self.number() if ranged else low
        if self.peek() != "}" or low is None and high is None or None not in (low, high) and low > high:
            raise SmartsError("unsupported_atom_primitive", self.at)
        self.at += 1
        return low, high

    def primitive(self, first: bool) -> tuple:
        c, text = self.peek(), self.text
        if not c or c in ";,&!:)":
            raise self.fail()
        if text.startswith("$(", self.at):
            return self.recursive()
        if c == "@":
            return self.chirality()
        if c in "+-":
            m = re.compile(r"\++|-+").match(text, self.at)
            self.at = m.end()
            size = len(m[0])
            if size == 1 and (n := self.number()) is not None:
                size = n
            if size > 127:
                raise self.fail("unsupported_atom_primitive")
            return "charge", size if c == "+" else -size
        if c == "*":
            self.at += 1
            return "any", None
        if c == "#":
            self.at += 1
            n = self.number()
            if n is None or not 0 < n < len(SYMBOLS):
                raise self.fail() if n is None else self.fail("unsupported_atom_primitive")
            return "number", n
        if c.isdigit():
            mass = self.number()
            if self.peek() == "*":
                self.at += 1
                return "mass", mass
            symbol = self.symbol()
            if symbol is None and self.peek() == "H":
                self.at += 1
                symbol = (1, False)
            if symbol is None:
                raise self.fail()
            return "isotope", (mass, *symbol)
        if c == "H" and not (text[self.at + 1 : self.at + 2].islower() and text[self.at : self.at + 2] in NUMBERS):
            self.at += 1
            if first and re.fullmatch(r"(?:\++\d*|-+\d*)?(?::\d+)?", text[self.at :]):
                return "symbol", (1, False)
            return "total_h", self.span()
        if (symbol := self.symbol()) is not None:
            return "symbol", symbol
        if c in "Aa":
            self.at += 1
            return ("aliphatic" if c == "A" else "aromatic"), None
        if c in NUMERIC:
            self.at += 1
            span = self.span()
            if span is None and c == "^":
                raise self.fail()
            return NUMERIC[c], span
        raise self.fail("unexpected_character" if c.isspace() or not c.isalpha() else "unsupported_atom_primitive")

    def symbol(self) -> tuple[int, bool] | None:
        for size in (2, 1):
            s = self.text[self.at : self.at + size]
            if len(s) == size:
                if s in AROMATIC_SYMBOLS:
                    self.at += size
                    return AROMATIC_SYMBOLS[s], True
                if s in NUMBERS and not (size == 1 and s == "H"):
                    self.at += size
                    return NUMBERS[s], False
        return None

    def chirality(self) -> tuple:
        m = re.compile(r"@(@|TH|AL|SP|TB|OH)?").match(self.text, self.at)
        self.at = m.end()
        if m[1] in (None, "@"):
            return "chiral", ("TH", 2 if m[1] else 1, m[0])
        n = self.number()
        n = 1 if n is None else n
        if not 0 < n <= CHIRAL_MOST[m[1]]:
            raise self.fail("unsupported_atom_primitive")
        return "chiral", (m[1], n, f"@{m[1]}{n}")

    def recursive(self) -> tuple:
        depth, start = 1, self.at + 2
        at = start
        while at < len(self.text) and depth:
            depth += {"(": 1, ")": -1}.get(self.text[at], 0)
            at += 1
        if depth:
            raise SmartsError("unexpected_end_of_input", at)
        inner = self.text[start : at - 1]
        if re.search(r"\s", inner):
            raise SmartsError("unexpected_character", start)
        if not inner:
            raise SmartsError("unexpected_character", start)
        self.at = at
        return "recursive", parse(inner)


@functools.lru_cache(50_000)
def _bracket(text: str) -> tuple[tuple, int | None, bool]:
    """Expression and atom map of a bracket's text, and whether one hydrogen is asked for. Patterns share most of their brackets; those with patterns inside are
    read anew each time."""
    expr, atom_map = _Bracket(text).parse()
    return expr, atom_map, any(node[0] == "total_h" and node[1] in (None, (1, 1)) and not negated for node, negated in primitives(expr))


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.q = text, 0, Query()
        self.rings: dict[int, tuple[int, tuple | None, int]] = {}

    def fail(self, code: str = "unexpected_character") -> SmartsError:
        return SmartsError("unexpected_end_of_input" if code == "unexpected_character" and self.at >= len(self.text) else code, self.at)

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\n\r":
            self.at += 1

    def run(self) -> Query:
        self.skip()
        if self.at == len(self.text):
            raise SmartsError("empty_input")
        stack: list[int] = []  # atoms that branches go out from
        groups: list[int] = []  # open component groups
        last: int | None = None
        component = group = 0
        fresh = True  # at the start of a component or branch
        while True:
            self.skip()
            c = self.text[self.at : self.at + 1]
            if not c:
                break
            if last is None:
                if c == "(":
                    groups.append(groups[-1] if groups else group)
                    group += len(groups) == 1
                    self.at += 1
                    continue
                if c == ")":
                    raise self.fail("unsupported_branch")
                if c == ">":
                    raise self.fail("unsupported_reaction")
                last = self.atom(None, None, component, groups[-1] if groups else None)
            elif c == ".":
                if stack:
                    raise self.fail()
                self.at += 1
                self.skip()
                if self.at == len(self.text) or self.text[self.at] in ".)":
                    raise self.fail()
                last, component = None, component + 1
            elif c == "(":
                if fresh:
                    raise self.fail()
                stack.append(last)
                self.at += 1
                self.skip()
                if self.text[self.at : self.at + 1] in ("(", ")", "."):
                    raise self.fail()
                bond = self.bond()
                last = self.atom(last, bond, component, groups[-1] if groups else None)
            elif c == ")":
                self.at += 1
                if stack:
                    last = stack.pop()
                elif groups:
                    groups.pop()
                    self.skip()
                    if self.at < len(self.text) and self.text[self.at] not in ".)":
                        raise self.fail()
                else:
                    raise self.fail("unsupported_branch")
            elif c == ">":
                raise self.fail("unsupported_reaction")
            else:
                bond = self.bond()
                self.skip()
                n = self.text[self.at : self.at + 1]
                if n.isdigit() or n == "%":
                    self.ring(last, bond)
                else:
                    last = self.atom(last, bond, component, groups[-1] if groups else None)
            fresh = False
        if stack or groups:
            raise SmartsError("unexpected_end_of_input", self.at)
        if self.rings:
            raise SmartsError("unclosed_ring_closure", self.at)
        return self.q

    def bond(self) -> tuple | None:
        if self.text[self.at : self.at + 1] not in (*BOND_SIGNS, "!"):
            return None
        return self.bond_level(0)

    def bond_level(self, depth: int) -> tuple:
        op, sign = LEVELS[depth]
        lower = (lambda: self.bond_level(depth + 1)) if depth < 2 else self.bond_primitive
        parts = [lower()]
        while (c := self.text[self.at : self.at + 1]) and (c == sign or op == "and" and c in BOND_SIGNS + "!"):
            if c == sign:
                self.at += 1
            parts.append(lower())
        return join(op, parts)

    def bond_primitive(self) -> tuple:
        odd = False
        while self.text[self.at : self.at + 1] == "!":
            self.at += 1
            odd = not odd
        c = self.text[self.at : self.at + 1]
        if not c or c not in BOND_SIGNS:
            raise self.fail()
        self.at += 1
        return ("not", ("bond", c)) if odd else ("bond", c)

    def ring(self, atom: int, bond: tuple | None) -> None:
        start = self.at
        m = re.compile(r"\d|%[1-9]\d(?!\d)|%\(\d{1,5}\)").match(self.text, start)
        if not m:
            rest = self.text[start:]
            raise SmartsError("unexpected_end_of_input" if re.fullmatch(r"%\(?\d{0,5}", rest) and not re.fullmatch(r"%0.*|%\d\d", rest) else "unexpected_character", start)
        self.at = m.end()
        number = int(m[0].strip("%()"))
        if number not in self.rings:
            self.rings[number] = (atom, bond, len(self.q.order[atom]))
            self.q.order[atom].append(-2)
            return
        a, other, slot = self.rings.pop(number)
        if a == atom:
            raise SmartsError("self_loop_ring_closure", start)
        if self.q.atoms[a].component != self.q.atoms[atom].component:
            raise SmartsError("cross_component_ring_closure", start)
        if bond is not None and other is not None and bond != other:
            raise SmartsError("conflicting_ring_closure_bond", start)
        self.q.order[a][slot] = atom
        self.q.order[atom].append(a)
        self.q.bonds.append(QueryBond(a, atom, other) if other is not None or bond is None else QueryBond(atom, a, bond))

    def atom(self, last: int | None, bond: tuple | None, component: int, group: int | None) -> int:
        text = self.text
        self.skip()
        if self.at >= len(text):
            raise self.fail()
        atom_map, bare, hydrogen = None, True, False
        if text[self.at] == "[":
            at = text.find("]", self.at)
            if at < 0 or "$(" in text[self.at : at]:
                depth, at = 0, self.at + 1
                while at < len(text) and (depth or text[at] != "]"):
                    depth += 1 if text.startswith("$(", at) else 1 if depth and text[at] == "(" else -1 if depth and text[at] == ")" else 0
                    at += 2 if text.startswith("$(", at) else 1
                if at >= len(text):
                    raise SmartsError("unterminated_bracket_atom", self.at)
                expr, atom_map, hydrogen = _bracket.__wrapped__(text[self.at + 1 : at])
            else:
                expr, atom_map, hydrogen = _bracket(text[self.at + 1 : at])
            self.at, bare = at + 1, False
        else:
            s = text[self.at : self.at + 2]
            if s not in BARE:
                s = s[0]
            if s in BARE:
                expr = ("symbol", (NUMBERS[s], False))
            else:
                if s == "*":
                    expr = ("any", None)
                elif s in "Aa":
                    expr = ("aliphatic" if s == "A" else "aromatic", None)
                elif s in AROMATIC_SYMBOLS:
                    expr = ("symbol", (AROMATIC_SYMBOLS[s], True))
                else:
                    raise self.fail()
            self.at += len(s)
        now = len(self.q.atoms)
        self.q.atoms.append(QueryAtom(expr, component, group, atom_map, bare))
        self.q.order.append([])
        if last is not None:
            self.q.bonds.append(QueryBond(last, now, bond))
            self.q.order[last].append(now)
            self.q.order[now].append(last)
        if hydrogen:
            self.q.order[now].append(-1)
        return now


def parse(text: str) -> Query:
    """Raises SmartsError with one of the codes of the error table."""
    return _Parser(text).run()


def error_code(text: str | None) -> str | None:
    """None for a valid pattern."""
    try:
        parse(text or "")
    except SmartsError as e:
        return e.code
    except RecursionError:
        return "unexpected_character"
    return None


def _span_text(span: tuple | None) -> str:
    if span is None:
        return ""
    low, high = span
    return str(low) if low == high else f"{{{'' if low is None else low}-{'' if high is None else high}}}"


def primitive_text(node: tuple) -> str:
    kind, value = node
    if kind == "bond":
        return value
    if kind in ("any", "aliphatic", "aromatic"):
        return {"any": "*", "aliphatic": "A", "aromatic": "a"}[kind]
    if kind == "symbol":
        return SYMBOLS[value[0]].lower() if value[1] else SYMBOLS[value[0]]
    if kind == "isotope":
        return f"{value[0]}{primitive_text(('symbol', value[1:]))}"
    if kind == "mass":
        return f"{value}*"
    if kind == "number":
        return f"#{value}"
    if kind == "charge":
        return ("+" if value >= 0 else "-") + ("" if abs(value) == 1 else str(abs(value)))
    if kind == "chiral":
        return value[2]
    if kind == "recursive":
        return f"$({to_smarts(value)})"
    return LETTER[kind] + _span_text(value)


def expr_text(node: tuple, depth: int = 0) -> str:
    """Text of a tree; an operator below a tighter one has no text of its own, as there are no brackets, and is refused."""
    op = node[0]
    if op == "not":
        if node[1][0] in ("and", "or", "low"):
            raise ValueError("the negation of an operator has no text")
        return "!" + expr_text(node[1], 3)
    for level, (name, sign) in enumerate(LEVELS):
        if op == name:
            if level < depth:
                raise ValueError("an operator below a tighter one has no text")
            parts = [expr_text(x, level + 1) for x in node[1:]]
            return sign.join(parts)
    return primitive_text(node)


def atom_text(atom: QueryAtom) -> str:
    if atom.bare:
        return primitive_text(atom.expr)
    return f"[{expr_text(atom.expr)}{'' if atom.atom_map is None else f':{atom.atom_map}'}]"


def to_smarts(query: Query) -> str:
    """Text with the atoms in their order where the bonds allow, ring closures numbered anew."""
    return write(query)[0]


def write(query: Query) -> tuple[str, list[int]]:
    """The text, and the atoms in the order in which they stand in it."""
    sequence: list[int] = []
    near = query.neighbours()
    seen: set[int] = set()
    closures: list[list[tuple[int, tuple | None, bool]]] = [[] for _ in query.atoms]
    children: list[list[tuple[int, int]]] = [[] for _ in query.atoms]
    used: set[int] = set()
    starts = []
    for root in range(len(query.atoms)):
        if root in seen:
            continue
        starts.append(root)
        seen.add(root)
        todo = [root]
        while todo:
            v = todo[-1]
            step = next(((w, i) for w, i in sorted(near[v]) if i not in used), None)
            if step is None:
                todo.pop()
                continue
            w, i = step
            used.add(i)
            if w in seen:
                closures[w].append((i, True))
                closures[v].append((i, False))
            else:
                seen.add(w)
                children[v].append((w, i))
                todo.append(w)
    number: dict[int, int] = {}

    def bond_text(i: int, start: int) -> str:
        bond = query.bonds[i]
        if bond.expr is None:
            return ""
        text = expr_text(bond.expr)
        return text if bond.a == start else text.translate(str.maketrans("/\\", "\\/"))

    def ring_text(v: int) -> str:
        out = ""
        for i, opens in sorted(closures[v], key=lambda x: x[1]):
            if opens:
                number[i] = next(k for k in range(1, 10_000) if k not in number.values())
                k, sign = number[i], bond_text(i, v)
            else:
                k, sign = number.pop(i), ""
            out += sign + (str(k) if k < 10 else f"%{k}" if k < 100 else f"%({k})")
        return out

    def written(root: int) -> str:
        out: list[str] = []
        todo: list = [root]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            sequence.append(item)
            out.append(atom_text(query.atoms[item]) + ring_text(item))
            for k, (w, i) in reversed(list(enumerate(children[item]))):
                last = k == len(children[item]) - 1
                todo += [w, bond_text(i, item)] if last else [")", w, "(" + bond_text(i, item)]
        return "".join(out)

    parts, at = [], 0
    while at < len(starts):
        group = query.atoms[starts[at]].group
        end = at + 1
        while group is not None and end < len(starts) and query.atoms[starts[end]].group == group:
            end += 1
        text = ".".join(written(r) for r in starts[at:end])
        parts.append(f"({text})" if group is not None else text)
        at = end
    return ".".join(parts), sequence
