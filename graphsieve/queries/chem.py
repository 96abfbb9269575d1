"""Pattern queries over molecules bound to the rows of part, each with SQL that knows no SMILES and no patterns, only atoms and bonds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsieve.functions.sql import function, register
from graphsieve.operators import match, screen
from graphsieve.queries.library import MOLECULES, SIZE, tables
from graphsieve.smarts import canonical, edit
from graphsieve.smarts import query as smarts_query
from graphsieve.smarts.query import parse, to_smarts
from graphsieve.sources import index_store
from graphsieve.sources import tables as source
from graphsieve.streaming import match as streaming
from graphsieve.workspace import new_path, written

Query = Callable[[SparkSession, str], DataFrame]


def library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(MOLECULES)), "lib long, smiles string")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One molecule for each row of part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mol_id"))
    return part.join(F.broadcast(library(spark)), F.col("mol_id") % SIZE == F.col("lib")).select("mol_id", "smiles")


def corpus(spark: SparkSession, sf_dir: str) -> source.Corpus:
    return source.from_smiles(molecules(spark, sf_dir))


# name: (pattern, condition on the atom a)
ATOMS = {
    "atom_wildcard": ("*", "true"),
    "atom_aliphatic": ("A", "NOT arom"),
    "atom_aromatic": ("a", "arom"),
    "atom_symbol": ("O", "z = 8 AND NOT arom"),
    "atom_aromatic_symbol": ("n", "z = 7 AND arom"),
    "atom_number": ("[#7]", "z = 7"),
    "atom_isotope_unspecified": ("[0*]", "isotope = 0"),
    "atom_isotope": ("[13C]", "isotope = 13 AND z = 6"),
    "atom_isotope_number": ("[13*]", "isotope = 13"),
    "atom_degree": ("[D2]", "degree = 2"),
    "atom_degree_default": ("[D]", "degree = 1"),
    "atom_connectivity": ("[X4]", "degree + h = 4"),
    "atom_valence": ("[v4]", "z = 6"),
    "atom_total_h": ("[H2]", "h = 2"),
    "atom_implicit_h": ("[h1]", "h = 1 AND isotope = 0 AND NOT (arom AND z = 7)"),
    "atom_charge": ("[-]", "charge = -1"),
    "atom_ring": ("[R]", "rings > 0"),
    "atom_ring_count": ("[R2]", "rings = 2"),
    "atom_ring_size": ("[r6]", "minring = 6"),
    "atom_ring_bonds": ("[x3]", "ringbonds = 3"),
    "atom_hetero_neighbours": ("[z2]", "hetero = 2"),
    "atom_aliphatic_hetero_neighbours": ("[Z1]", "(SELECT count(*) FROM b JOIN a o ON o.lib = b.lib AND o.atom = b.y WHERE b.lib = a.lib AND b.x = a.atom AND o.z NOT IN (1, 6) AND NOT o.arom) = 1"),
    "atom_hydrogen_before_bracket_end": ("[#7;H]", "z = 7 AND h = 1"),
    "atom_map": ("[C:7]", "z = 6 AND NOT arom"),
    "atom_turn_not_tetrahedral": ("[C@SP2]", "z = 6 AND NOT arom"),
    "atom_hybridization": ("[^1]", "EXISTS (SELECT 1 FROM b WHERE b.lib = a.lib AND b.x = a.atom AND b.label = 'T')"),
    "atom_range": ("[D{2-3}]", "degree BETWEEN 2 AND 3"),
    "bool_not": ("[!#6]", "z <> 6"),
    "bool_precedence": ("[N,O&H1]", "z = 7 AND NOT arom OR z = 8 AND NOT arom AND h = 1"),
    "bool_low_and": ("[N,O;H1]", "(z = 7 OR z = 8) AND NOT arom AND h = 1"),
}
# name: (pattern, condition on atom p, condition on atom q, condition on the bond e)
_C, _O, _N = (f"{{0}}.z = {z} AND NOT {{0}}.arom" for z in (6, 8, 7))
PAIRS = {
    "bond_elided": ("CO", _C, _O, "e.label IN ('S', 'A')"),
    "bond_single": ("C-C", _C, _C, "e.label = 'S'"),
    "bond_double": ("C=O", _C, _O, "e.label = 'D'"),
    "bond_triple": ("C#N", _C, _N, "e.label = 'T'"),
    "bond_aromatic": ("a:a", "{0}.arom", "{0}.arom", "e.label = 'A'"),
    "bond_any": ("C~*", _C, "true", "true"),
    "bond_ring": ("*@*", "true", "true", "e.ring"),
    "bond_not": ("C!-*", _C, "true", "e.label <> 'S'"),
    "bond_or": ("C=,#*", _C, "true", "e.label IN ('D', 'T')"),
    "bond_low_and": ("*:;@*", "true", "true", "e.label = 'A' AND e.ring"),
    "bond_direction_alone": ("C/O", _C, _O, "e.label = 'S'"),
    "bond_no_direction": ("C!/O", _C, _O, "false"),
    "bond_not_ring": ("*!@*", "true", "true", "NOT e.ring"),
}


def pair_sql(p: str, q: str, e: str) -> str:
    return f"SELECT p.lib, least(p.atom, q.atom) AS m0, greatest(p.atom, q.atom) AS m1 FROM a p JOIN b e ON e.lib = p.lib AND e.x = p.atom JOIN a q ON q.lib = e.lib AND q.atom = e.y WHERE {p.format('p')} AND {q.format('q')} AND {e}"


_CO_PAIRS = pair_sql(_C, _O, "e.label IN ('S', 'A')")
_CN_PAIRS = pair_sql(_C, _N, "e.label IN ('S', 'A')")
_ACID = "a p JOIN b e ON e.lib = p.lib AND e.x = p.atom AND e.label = 'D' JOIN a q ON q.lib = p.lib AND q.atom = e.y AND q.z = 8 JOIN b f ON f.lib = p.lib AND f.x = p.atom AND f.label = 'S' JOIN a r ON r.lib = p.lib AND r.atom = f.y AND r.atom <> q.atom"
_NEXT = "EXISTS (SELECT 1 FROM b JOIN a o ON o.lib = b.lib AND o.atom = b.y WHERE b.lib = {0}.lib AND b.x = {0}.atom AND {1})"
_CO, _CDO = _NEXT.format("a", "b.label = 'S' AND o.z = 8"), _NEXT.format("p", "b.label = 'D' AND o.z = 8")
# name: (pattern, SQL for one row for each distinct set of atoms, with lib)
OTHERS = {
    "path_three": ("CC=O", "SELECT DISTINCT p.lib, r.atom AS m0, p.atom AS m1, q.atom AS m2 FROM " + _ACID + " WHERE r.z = 6 AND NOT r.arom AND p.z = 6"),
    "branch_acid": ("C(=O)[O;H1,-]", "SELECT DISTINCT p.lib, p.atom AS m0, q.atom AS m1, r.atom AS m2 FROM " + _ACID + " WHERE p.z = 6 AND r.z = 8 AND (r.h = 1 OR r.charge = -1)"),
    "ring_closing": ("C1CC1", "SELECT DISTINCT lib, 0 AS m0 FROM r0 WHERE size = 3"),
    "ring_aromatic": ("c1ccccc1", "SELECT DISTINCT r0.lib, ring AS m0 FROM r0 WHERE size = 6 AND NOT EXISTS (SELECT 1 FROM r0 s JOIN a ON a.lib = s.lib AND a.atom = s.atom WHERE s.lib = r0.lib AND s.ring = r0.ring AND (a.z <> 6 OR NOT a.arom))"),
    "recursive_positive": ("[$(CO)]", f"SELECT lib, atom AS m0 FROM a WHERE z = 6 AND NOT arom AND {_CO}"),
    "recursive_negative": ("[C;!$(C=O)]-O", f"SELECT DISTINCT p.lib, p.atom AS m0, q.atom AS m1 FROM a p JOIN b e ON e.lib = p.lib AND e.x = p.atom AND e.label = 'S' JOIN a q ON q.lib = p.lib AND q.atom = e.y WHERE p.z = 6 AND NOT p.arom AND q.z = 8 AND NOT {_CDO}"),
    "recursive_nested": ("[$(C[$(C=O)])]", f"SELECT DISTINCT c.lib, c.atom AS m0 FROM a c JOIN b e ON e.lib = c.lib AND e.x = c.atom AND e.label = 'S' JOIN a p ON p.lib = c.lib AND p.atom = e.y WHERE c.z = 6 AND NOT c.arom AND p.z = 6 AND {_CDO}"),
    "component_free": ("C.O", "SELECT p.lib, p.atom AS m0, q.atom AS m1 FROM a p JOIN a q ON q.lib = p.lib WHERE p.z = 6 AND NOT p.arom AND q.z = 8 AND NOT q.arom"),
    "component_same": ("(C.O)", "SELECT p.lib, p.atom AS m0, q.atom AS m1 FROM a p JOIN a q ON q.lib = p.lib WHERE p.z = 6 AND NOT p.arom AND q.z = 8 AND NOT q.arom AND p.component = q.component"),
    "component_edges": ("CO.CN", f"SELECT DISTINCT lib, m[1] AS m0, m[2] AS m1, m[3] AS m2, m[4] AS m3 FROM (SELECT p.lib, list_sort([p.m0, p.m1, q.m0, q.m1]) AS m FROM ({_CO_PAIRS}) p JOIN ({_CN_PAIRS}) q ON q.lib = p.lib AND q.m0 NOT IN (p.m0, p.m1) AND q.m1 NOT IN (p.m0, p.m1))"),
    "component_other": ("(C).([Na])", "SELECT p.lib, p.atom AS m0, q.atom AS m1 FROM a p JOIN a q ON q.lib = p.lib WHERE p.z = 6 AND NOT p.arom AND q.z = 11 AND p.component <> q.component"),
}


def counted(smarts: str) -> Query:
    return lambda spark, sf_dir: match.counts(corpus(spark, sf_dir), smarts, joined=True)


def _joined(rows: str, columns: str = "n", table: str = "n") -> str:
    return f"SELECT p_partkey AS mol_id, {columns} FROM part JOIN {table} ON p_partkey % {SIZE} = {table}.lib"


def counted_sql(rows: str) -> str:
    return f"WITH {tables()}, hits AS ({rows}), n AS (SELECT lib, count(*) AS n FROM (SELECT DISTINCT * FROM hits) GROUP BY lib) {_joined(rows)}"


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Every pattern above with the SQL of its rows, numbered.
EVERY: list[tuple[int, str, str, str]] = []
for _name, (_smarts, _where) in ATOMS.items():
    EVERY.append((len(EVERY), _name, _smarts, f"SELECT lib, atom AS m0 FROM a WHERE {_where}"))
for _name, (_smarts, _p, _q, _e) in PAIRS.items():
    EVERY.append((len(EVERY), _name, _smarts, pair_sql(_p, _q, _e)))
for _name, (_smarts, _rows) in OTHERS.items():
    EVERY.append((len(EVERY), _name, _smarts, _rows))
for _, _name, _smarts, _rows in EVERY:
    QUERIES[_name], ORACLES[_name] = counted(_smarts), counted_sql(_rows)
PATTERNS = [(i, smarts) for i, _, smarts, _ in EVERY]
_ALL_COUNTS = "all_counts AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, lib, count(*) AS n FROM (SELECT DISTINCT * FROM ({rows})) GROUP BY lib" for i, _, _, rows in EVERY) + ")"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def keyed(name: str, sql: str, columns: str, table: str = "found", condition: str = "") -> None:
    """The SQL of a query whose rows are those of a table by lib, for each row of part."""
    ORACLES[name] = f"WITH {tables()}, {sql} SELECT p_partkey AS mol_id, {columns} FROM part JOIN {table} ON p_partkey % {SIZE} = {table}.lib {condition}"


_CARBONYL = pair_sql(_C, _O, "e.label = 'D'")
_SINGLE_CO = "hits AS (SELECT p.lib, p.atom AS c, q.atom AS o FROM a p JOIN b e ON e.lib = p.lib AND e.x = p.atom AND e.label = 'S' JOIN a q ON q.lib = p.lib AND q.atom = e.y WHERE p.z = 6 AND NOT p.arom AND q.z = 8)"
_SHOWN = "found AS (SELECT lib, string_agg(c || '-' || o, ';' ORDER BY least(c, o), greatest(c, o)) AS embeddings FROM hits GROUP BY lib)"
_COVERED = (
    "touched AS (SELECT lib, count(*) AS n FROM (SELECT lib, c AS v, -1 AS w FROM hits UNION SELECT lib, o, -1 FROM hits UNION SELECT lib, c, o FROM hits) GROUP BY lib), "
    "found AS (SELECT lib, touched.n IS NOT NULL AS matched, coalesce(touched.n, 0) / CAST(size AS DOUBLE) AS coverage FROM (SELECT lib, count(*) AS size FROM (SELECT lib FROM a UNION ALL SELECT lib FROM b0) GROUP BY lib) LEFT JOIN touched USING (lib))"
)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("mol_id", F.array_join(F.transform("embeddings", lambda e: F.array_join(e, "-")), ";").alias("embeddings"))


@query
def match_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.exists(corpus(spark, sf_dir), "C=O", joined=True)


keyed("match_exists", f"found AS (SELECT DISTINCT lib FROM ({_CARBONYL}))", "")
ORACLES["match_exists"] = ORACLES["match_exists"].replace("mol_id,  FROM", "mol_id FROM")


@query
def match_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(match.embeddings(corpus(spark, sf_dir), "CO", joined=True))


@query
def batch_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(match.embeddings(corpus(spark, sf_dir), "CO"))


for _name in ("match_embeddings", "batch_embeddings"):
    keyed(_name, f"{_SINGLE_CO}, {_SHOWN}", "embeddings")


@query
def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.coverage(corpus(spark, sf_dir), "CO", joined=True)


@query
def batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.coverage(corpus(spark, sf_dir), parse("CO"))


for _name in ("match_coverage", "batch_coverage"):
    keyed(_name, f"{_SINGLE_CO}, {_COVERED}", "matched, coverage")


@query
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern of this module against every molecule, without a shuffle."""
    return match.by_batch(corpus(spark, sf_dir).packed, PATTERNS)


@query
def canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the patterns' canonical forms, which must mean the same."""
    return match.by_batch(corpus(spark, sf_dir).packed, [(i, canonical.canonical_smarts(p)) for i, p in PATTERNS])


@query
def rewritten_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the patterns as they are written out again."""
    return match.by_batch(corpus(spark, sf_dir).packed, [(i, to_smarts(parse(p))) for i, p in PATTERNS])


for _name in ("batch_counts", "canonical_counts", "rewritten_counts"):
    keyed(_name, _ALL_COUNTS, "query_id, n", "all_counts")


@query
def batch_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.by_batch(corpus(spark, sf_dir).packed, PATTERNS, "exists")


keyed("batch_exists", _ALL_COUNTS, "query_id", "all_counts")

_NEEDS = [(0, "C", 3), (1, "[#8]", 2), (2, "C-*", 4), (3, "a", 6), (4, "N", 0)]


@query
def match_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules on which patterns lie so many times at least."""
    return match.at_least(corpus(spark, sf_dir), _NEEDS)


keyed(
    "match_thresholds",
    "sums AS (SELECT lib, count(*) FILTER (z = 6 AND NOT arom) AS q0, count(*) FILTER (z = 8) AS q1, count(*) FILTER (arom) AS q3 FROM a GROUP BY lib), "
    f"pairs AS (SELECT lib, count(*) AS q2 FROM (SELECT DISTINCT * FROM ({pair_sql(_C, 'true', "e.label = 'S'")})) GROUP BY lib), "
    "found AS (SELECT lib, unnest([0, 1, 2, 3, 4]) AS query_id, unnest([q0 >= 3, q1 >= 2, coalesce(q2, 0) >= 4, q3 >= 6, true]) AS good FROM sums LEFT JOIN pairs USING (lib))",
    "query_id::BIGINT AS query_id",
    condition="WHERE good",
)

# Patterns of three atoms in a row, by rule: the ends and the middle by element and aromaticity, the bonds by kind.
_ELEMENTS = [("C", 6, False), ("N", 7, False), ("O", 8, False), ("c", 6, True), ("n", 7, True), ("F", 9, False), ("Cl", 17, False)]
_KINDS = [("-", "S"), ("=", "D"), ("#", "T"), (":", "A"), ("~", "SDTA")]
_PATHS = [(x, i, y, j, z) for x in _ELEMENTS for i in _KINDS for y in _ELEMENTS[:4] for j in _KINDS[:4] for z in _ELEMENTS[:3]][::4]


@query
def batch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some hundred patterns made by rule against every molecule."""
    return match.by_batch(corpus(spark, sf_dir).packed, [(k, f"{x[0]}{i[0]}{y[0]}{j[0]}{z[0]}") for k, (x, i, y, j, z) in enumerate(_PATHS)])


_PATH_VALUES = ",".join(f"({k},{x[1]},{str(x[2]).lower()},'{i[1]}',{y[1]},{str(y[2]).lower()},'{j[1]}',{z[1]},{str(z[2]).lower()})" for k, (x, i, y, j, z) in enumerate(_PATHS))
keyed(
    "batch_paths",
    f"wanted(query_id, z0, r0_, k0, z1, r1_, k1, z2, r2_) AS (VALUES {_PATH_VALUES}), "
    "paths AS (SELECT e.lib, o.z AS z0, o.arom AS r0_, e.label AS l0, p.z AS z1, p.arom AS r1_, f.label AS l1, q.z AS z2, q.arom AS r2_, least(o.atom, q.atom) AS low, p.atom AS mid, greatest(o.atom, q.atom) AS high "
    "FROM b e JOIN b f ON f.lib = e.lib AND f.x = e.x AND f.y <> e.y JOIN a o ON o.lib = e.lib AND o.atom = e.y JOIN a p ON p.lib = e.lib AND p.atom = e.x JOIN a q ON q.lib = e.lib AND q.atom = f.y), "
    "found AS (SELECT query_id, lib, count(DISTINCT list_sort([low, mid, high])) AS n FROM paths JOIN wanted USING (z0, r0_, z1, r1_, z2, r2_) WHERE contains(k0, l0) AND contains(k1, l1) GROUP BY ALL)",
    "query_id::BIGINT AS query_id, n",
)


@query
def match_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of many parts, fused rings and long paths, from texts."""
    return match.by_kernel(molecules(spark, sf_dir), _LARGE).select("mol_id", "query_id", "n")


@query
def batch_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.by_batch(corpus(spark, sf_dir).packed, _LARGE)


_LARGE = [(1, "c1ccc2ccccc2c1"), (2, "C.C.[#8].[#8].[#7]"), (3, "*~*~*~*~*")]
_LARGE_SQL = """naph AS (SELECT lib FROM lib WHERE s = 15), kinds AS (SELECT lib, count(*) FILTER (z = 6 AND NOT arom) AS c, count(*) FILTER (z = 8) AS o, count(*) FILTER (z = 7) AS n FROM a GROUP BY lib),
five AS (SELECT e.lib, count(DISTINCT list_sort([e.x, e.y, f.y, g.y, h.y])) AS n FROM b e JOIN b f ON f.lib = e.lib AND f.x = e.y AND f.y <> e.x JOIN b g ON g.lib = e.lib AND g.x = f.y AND g.y NOT IN (e.x, e.y)
  JOIN b h ON h.lib = e.lib AND h.x = g.y AND h.y NOT IN (e.x, e.y, f.y) GROUP BY e.lib),
counts AS (SELECT lib, 1 AS query_id, 1 AS n FROM naph UNION ALL SELECT lib, 2, (c * (c - 1) // 2) * (o * (o - 1) // 2) * n FROM kinds UNION ALL SELECT lib, 3, n FROM five)"""
keyed("batch_large", f"{_LARGE_SQL}, found AS (SELECT lib, query_id, n FROM counts WHERE n > 0)", "query_id::BIGINT AS query_id, n::BIGINT AS n")
keyed("match_kernel", f"{_LARGE_SQL}, found AS (SELECT lib.lib, q.query_id, coalesce(n, 0) AS n FROM lib CROSS JOIN (VALUES (1), (2), (3)) q(query_id) LEFT JOIN counts ON counts.lib = lib.lib AND counts.query_id = q.query_id)", "query_id::BIGINT AS query_id, n::BIGINT AS n")


@query
def bondless_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven parts: whether there is an atom of its own for each."""
    return match.exists(corpus(spark, sf_dir), "[#6].[#6].[#6].[#6].[#8].[#8].[#7,#8]")


keyed("bondless_exists", "found AS (SELECT lib FROM a GROUP BY lib HAVING count(*) FILTER (z = 6) >= 4 AND count(*) FILTER (z = 8) >= 2 AND count(*) FILTER (z IN (7, 8)) >= 3)", "lib AS _")
ORACLES["bondless_exists"] = ORACLES["bondless_exists"].replace("mol_id, lib AS _ FROM", "mol_id FROM")


@query
def match_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are given no time are exceeded, and their answers null."""
    return match.by_kernel(molecules(spark, sf_dir), [(1, "C"), (2, "C.O")], seconds=0.0).select("mol_id", "query_id", "exceeded", F.col("matched").isNull().alias("unanswered"))


ORACLES["match_deadline"] = "SELECT p_partkey AS mol_id, query_id::BIGINT AS query_id, true AS exceeded, true AS unanswered FROM part, (VALUES (1), (2)) q(query_id)"


@query
def match_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interrupt that never comes leaves as it is."""
    return match.by_kernel(molecules(spark, sf_dir), [(1, "C=O")], "exists", interrupt=bool).select("mol_id", "matched", "exceeded")


keyed("match_interrupted", f"found AS (SELECT lib, EXISTS (SELECT 1 FROM ({_CARBONYL}) h WHERE h.lib = lib.lib) AS matched FROM lib)", "matched, false AS exceeded")

# Stereo: centres and double bonds put together by rule; a centre with its neighbours in another order turns by the parity of that order.
_ARMS = ("F", "Cl", "Br", "I")


@query
def stereo_tetrahedral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centre with four different neighbours in each order, against one written in the first order."""
    return match.by_batch(_stereo_corpus(spark, sf_dir, _centres()).packed, [(1, "F[C@](Cl)(Br)I"), (2, "F[C@@](Cl)(Br)I")], "exists")


def _centres() -> list[str]:
    return ["{}[C{}]({})({}){}".format(_ARMS[a], turn, *(_ARMS[x] for x in (b, c, d))) for a in range(4) for b in range(4) for c in range(4) for d in range(4) if len({a, b, c, d}) == 4 for turn in ("@", "@@", "")]


def _stereo_corpus(spark: SparkSession, sf_dir: str, texts: list[str]) -> source.Corpus:
    known = F.array(*[F.lit(t) for t in texts])
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return source.from_smiles(part.select(F.col("p_partkey").alias("mol_id"), F.get(known, (F.col("p_partkey") % len(texts)).cast("int")).alias("smiles")))


ORACLES["stereo_tetrahedral"] = """WITH n AS (SELECT unnest(range(4)) AS v),
orders AS (SELECT row_number() OVER (ORDER BY a.v, b.v, c.v, d.v) - 1 AS k, ((a.v > b.v)::INT + (a.v > c.v)::INT + (a.v > d.v)::INT + (b.v > c.v)::INT + (b.v > d.v)::INT + (c.v > d.v)::INT) % 2 AS odd
  FROM n a, n b, n c, n d WHERE a.v NOT IN (b.v, c.v, d.v) AND b.v NOT IN (c.v, d.v) AND c.v <> d.v),
cases AS (SELECT 3 * k + turn AS id, CASE turn WHEN 2 THEN 0 ELSE 1 + (odd + turn) % 2 END AS query_id FROM orders, (VALUES (0), (1), (2)) t(turn))
SELECT p_partkey AS mol_id, query_id::BIGINT AS query_id FROM part JOIN cases ON p_partkey % 72 = id WHERE query_id > 0"""


@query
def stereo_double_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A double bond with a marked neighbour on each side, or none, against both sides."""
    texts = [f"F{i}C=C{j}Cl" for i in ("/", "\\", "") for j in ("/", "\\", "")]
    return match.by_batch(_stereo_corpus(spark, sf_dir, texts).packed, [(1, "F/C=C/Cl"), (2, "F/C=C\\Cl"), (3, "FC=CCl")], "exists")


ORACLES["stereo_double_bond"] = """WITH cases AS (SELECT 3 * i + j AS id, i, j FROM range(3) a(i), range(3) b(j)),
found AS (SELECT id, CASE WHEN i = 2 OR j = 2 THEN 0 WHEN i = j THEN 1 ELSE 2 END AS query_id FROM cases UNION ALL SELECT id, 3 FROM cases)
SELECT p_partkey AS mol_id, query_id::BIGINT AS query_id FROM part JOIN found ON p_partkey % 9 = id WHERE query_id > 0"""


def _function(name: str, made: Callable[[], F.Column], function_name: str, sql: str, *pattern: str) -> None:
    """A query of a function over texts that are made of p_partkey, as patterns, or as molecules with a pattern; and the answer out of p_partkey as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
        return part.select("p_partkey", function(function_name)(made(), *map(F.lit, pattern)).alias("answer"))

    QUERIES[name], ORACLES[name] = run, f"SELECT p_partkey, {sql} AS answer FROM part"


def _text() -> F.Column:
    """1 to 3 parts, the first of 1 to 5 atoms in a row; where p_partkey is divisible by 7 the last bond lacks its atom."""
    return F.expr("concat('[#6;D', p_partkey % 4, ']', repeat('-[C,N]', CAST(p_partkey % 5 AS INT)), repeat('.C', CAST(p_partkey % 3 AS INT)), if(p_partkey % 7 = 0, '-', ''))")


def _made(text: str) -> Callable[[], F.Column]:
    return lambda: F.expr(text)


_BROKEN = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE "
_function("parse_valid", _text, "smarts_valid", "p_partkey % 7 <> 0")
_function("parse_atoms", _text, "smarts_atom_count", _BROKEN + "1 + p_partkey % 5 + p_partkey % 3 END")
_function("parse_bonds", _text, "smarts_bond_count", _BROKEN + "p_partkey % 5 END")
_function("parse_components", _text, "smarts_component_count", _BROKEN + "1 + p_partkey % 3 END")
_function("recursive_depth", _made("concat(repeat('[$(C', CAST(p_partkey % 5 AS INT)), 'O', repeat(')]', CAST(p_partkey % 5 AS INT)))"), "smarts_recursive_depth", "p_partkey % 5")
_function("write_pattern", _made("concat('[#6&D', p_partkey % 5, ',', repeat('!', CAST(2 * (p_partkey % 3) AS INT)), 'n]O')"), "smarts_text", "'[#6&D' || p_partkey % 5 || ',n]O'")
_function("smiles_count", _made("concat('C1', repeat('C', CAST(p_partkey % 6 AS INT) + 1), 'C1')"), "smiles_match_count", "p_partkey % 6 + 3", "C@C")
_function("smiles_coverage", _made("concat('O', repeat('C', CAST(p_partkey % 6 AS INT) + 1))"), "smiles_match_coverage", "3 / CAST(2 * (p_partkey % 6 + 2) - 1 AS DOUBLE)", "CO")

#: Texts with the codes that they are rejected with; the codes are fixed values.
REJECTED = (
    ("CC(=O)O", None), ("", "empty_input"), ("   ", "empty_input"), ("C1CC", "unclosed_ring_closure"), ("C>>O", "unsupported_reaction"), ("C=1CC#1", "conflicting_ring_closure_bond"), ("[C", "unterminated_bracket_atom"),
    ("Pt", "unexpected_character"), ("[D{3-1}]", "unsupported_atom_primitive"), ("[D{-}]", "unsupported_atom_primitive"), ("[R{2-1}]", "unsupported_atom_primitive"), ("[C{3-1}]", "unexpected_character"), ("[]", "unexpected_end_of_input"),
    ("[C@TH3]", "unsupported_atom_primitive"), ("C11", "self_loop_ring_closure"), ("C1.C1", "cross_component_ring_closure"), ("C)", "unsupported_branch"), ("[C H1]", "unexpected_character"), ("[#6;H{1-2}]", None), ("[D{2-3}]", None),
    ("[D{}]", "unsupported_atom_primitive"), ("[X{2x}]", "unsupported_atom_primitive"), ("[D70000]", "unsupported_atom_primitive"), ("[D{2}]", None),
)
_function(
    "parse_errors",
    lambda: F.get(F.array(*[F.lit(t) for t, _ in REJECTED]), (F.col("p_partkey") % len(REJECTED)).cast("int")),
    "smarts_error_code",
    f"(ARRAY[{','.join('NULL' if c is None else f"'{c}'" for _, c in REJECTED)}])[p_partkey % {len(REJECTED)} + 1]",
)


@query
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three atoms in both directions and with their operands in any order: how many rows of part share a form, and how many forms are shared so."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    atom = lambda k: F.get(F.array(*[F.lit(t) for t in ("C", "[C]", "N", "[O;D2]", "[D2;O]")]), k.cast("int"))
    bond = lambda k: F.get(F.array(F.lit("="), F.lit("#")), k.cast("int"))
    key = F.col("p_partkey")
    text = F.concat(atom(key % 5), bond(F.floor(key / 5) % 2), atom(F.floor(key / 10) % 5), bond(F.floor(key / 50) % 2), atom(F.floor(key / 100) % 5))
    forms = part.select(function("smarts_canonical")(text).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("members"))
    return forms.groupBy("members").agg(F.count(F.lit(1)).alias("forms"))


ORACLES["canonical_dedupe"] = """WITH d AS (SELECT p_partkey % 5 AS x, p_partkey // 5 % 2 AS i, p_partkey // 10 % 5 AS y, p_partkey // 50 % 2 AS j, p_partkey // 100 % 5 AS z FROM part),
e AS (SELECT ([0, 0, 1, 2, 2])[x + 1] AS x, i, ([0, 0, 1, 2, 2])[y + 1] AS y, j, ([0, 0, 1, 2, 2])[z + 1] AS z FROM d),
forms AS (SELECT least([x, i, y, j, z], [z, j, y, i, x]) AS form, count(*) AS members FROM e GROUP BY 1)
SELECT members, count(*) AS forms FROM forms GROUP BY members"""


@query
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row a ring pattern written from another atom on: that its labelling maps it to the same text, and is a permutation."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    ring = F.array(*[F.lit(t) for t in ("C", "N", "O", "S", "P", "F")])
    turn = (F.col("p_partkey") % 6).cast("int")
    turned = F.concat(F.slice(ring, turn + 1, 6), F.slice(ring, 1, turn))
    text = F.concat(F.get(turned, 0), F.lit("1"), F.array_join(F.slice(turned, 2, 5), ""), F.lit("1"))
    found = part.select("p_partkey", function("smarts_canonical")(text).alias("form"), function("smarts_labeling")(text).alias("label"))
    first = found.agg(F.min("form").alias("least"))
    return found.crossJoin(F.broadcast(first)).select("p_partkey", (F.col("form") == F.col("least")).alias("same"), F.array_join(F.array_sort("label"), " ").alias("atoms"))


ORACLES["canonical_order"] = "SELECT p_partkey, true AS same, '0 1 2 3 4 5' AS atoms FROM part"


def _edits() -> list[tuple[int, object]]:
    """Patterns after an edit, made on the driver as patterns are; the SQL says what they must match."""
    q, c, n = parse("CC(N)O"), parse("CCO"), parse("N").atoms[0].expr
    made = [
        edit.attach_leaf(c, 2, None, parse("C").atoms[0].expr)[0],  # CCOC
        edit.remove_leaf(q, 2),  # CCO
        edit.insert_on_bond(parse("CC"), 0, None, parse("O").atoms[0].expr, None)[0],  # COC
        edit.replace_atom(parse("CO"), 1, n)[0],  # CN
        edit.replace_bond(parse("CO"), 0, ("bond", "="))[0],  # C=O
        edit.close_ring(parse("CCC"), 0, 2)[0],  # C1CC1
        edit.open_ring(parse("C1CC1"), 0),  # CCC
        edit.remove_bond(parse("CO"), 0),  # C.O
        edit.remove_atom(parse("CCO"), 0),  # CO
        edit.add_atom(parse("C"), 1, n)[0],  # C.N
        edit.clone_subgraph(q, [1, 3]),  # CO
        edit.graft(parse("C"), 0, None, parse("O"), 0)[0],  # CO
        edit.replace_subtree(parse("CCN"), 1, 2, parse("O"), 0)[0],  # CCO
        edit.add_bond(*(lambda made: (made[0], 0, made[1]))(edit.add_atom(parse("C"), 0, n)), ("bond", "-"))[0],  # C-N
    ]
    return list(enumerate(made))


@query
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edited patterns match."""
    return match.by_batch(corpus(spark, sf_dir).packed, _edits())


def _tree(atoms: list[int], bonds: list[tuple[int, int, str]]) -> str:
    """SQL for the rows of a pattern of aliphatic atoms with bonds of the given labels, by distinct set of atoms."""
    tables_ = ", ".join(f"a t{i}" for i in range(len(atoms))) + "".join(f", b e{k}" for k in range(len(bonds)))
    where = [f"t{i}.z = {z} AND NOT t{i}.arom" for i, z in enumerate(atoms)] + [f"t{i}.lib = t0.lib" for i in range(1, len(atoms))]
    where += [f"e{k}.lib = t0.lib AND e{k}.x = t{i}.atom AND e{k}.y = t{j}.atom AND contains('{labels}', e{k}.label)" for k, (i, j, labels) in enumerate(bonds)]
    where += [f"t{i}.atom <> t{j}.atom" for i in range(len(atoms)) for j in range(i)]
    return f"SELECT t0.lib, list_sort([{', '.join(f't{i}.atom' for i in range(len(atoms)))}]) AS m FROM {tables_} WHERE {' AND '.join(where)}"


_CCO, _CO_TREE = ([6, 6, 8], [(0, 1, "SA"), (1, 2, "SA")]), ([6, 8], [(0, 1, "SA")])
_EDITED = [
    ([6, 6, 8, 6], [(0, 1, "SA"), (1, 2, "SA"), (2, 3, "SA")]), _CCO, ([6, 8, 6], [(0, 1, "SA"), (1, 2, "SA")]), ([6, 7], [(0, 1, "SA")]), ([6, 8], [(0, 1, "D")]), ([6, 6, 6], [(0, 1, "SA"), (1, 2, "SA"), (0, 2, "SA")]),
    ([6, 6, 6], [(0, 1, "SA"), (1, 2, "SA")]), ([6, 8], []), _CO_TREE, ([6, 7], []), _CO_TREE, _CO_TREE, _CCO, ([6, 7], [(0, 1, "S")]),
]
keyed("edit_counts", "found AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS query_id, lib, count(DISTINCT m) AS n FROM ({_tree(*t)}) GROUP BY lib" for k, t in enumerate(_EDITED)) + ")", "query_id, n")


@query
def edit_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, branch atoms, bonds in rings and in chains, and what is reached from atom 0 without atom 1, of chains, stars and rings of n atoms."""
    rows = []
    for n in range(3, 9):
        for kind, text in (("chain", "C" * n), ("star", "C" + "(C)" * (n - 2) + "C"), ("ring", "C1" + "C" * (n - 2) + "C1")):
            q = parse(text)
            rows.append((kind, n, len(edit.leaf_atoms(q)), len(edit.branch_atoms(q)), len(edit.ring_bonds(q)), len(edit.chain_bonds(q)), len(edit.rooted_subtree(q, 0, 1)), edit.validate(q) is None))
    return spark.createDataFrame(rows, "kind string, n long, leaves long, branches long, ring_bonds long, chain_bonds long, reached long, valid boolean")


ORACLES["edit_analysis"] = """SELECT kind, n, CASE kind WHEN 'chain' THEN 2 WHEN 'star' THEN n - 1 ELSE 0 END AS leaves, CAST(CASE WHEN kind = 'star' AND n > 3 THEN 1 ELSE 0 END AS BIGINT) AS branches,
  CASE kind WHEN 'ring' THEN n ELSE 0 END AS ring_bonds, CASE kind WHEN 'ring' THEN 0 ELSE n - 1 END AS chain_bonds, CASE kind WHEN 'chain' THEN 1 WHEN 'star' THEN n - 1 ELSE n - 1 END AS reached, true AS valid
FROM range(3, 9) t(n), (VALUES ('chain'), ('star'), ('ring')) k(kind)"""


@query
def edit_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates put to, taken from and exchanged in atom expressions, by what they then match."""
    o, d2 = parse("[#8]").atoms[0].expr, ("degree", (2, 2))
    both = edit.add_primitive(o, d2)
    last = edit.paths(both)[-1]
    made = [both, edit.remove_primitive(both, last), edit.replace_primitive(both, last, ("degree", (1, 1)))[0], edit.normalize(("not", ("not", ("and", o))))]
    wrapped = [smarts_query.Query([smarts_query.QueryAtom(e)], [], [[]]) for e in made]
    return match.by_batch(corpus(spark, sf_dir).packed, list(enumerate(wrapped)))


keyed(
    "edit_expressions",
    "found AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS query_id, lib, count(*) AS n FROM a WHERE z = 8{w} GROUP BY lib" for k, w in enumerate((" AND degree = 2", "", " AND degree = 1", ""))) + ")",
    "query_id, n",
)

_SCREENED = [(1, "C=O"), (2, "c"), (3, "C-C=O"), (4, "C#N"), (5, "[C;R]")]


def _index(spark: SparkSession, sf_dir: str) -> tuple[source.Corpus, DataFrame]:
    """The index, stored, as it is read several times."""
    held = corpus(spark, sf_dir)
    return held, written(screen.features(held), "index")


@query
def screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules with counts enough for a carbonyl, and for a ring of three."""
    _, index = _index(spark, sf_dir)
    return screen.may_match(index, screen.requirement_table(spark, [(1, "C=O"), (2, "C1CC1")])).select("mol_id", "query_id")


keyed(
    "screen_counts",
    """sums AS (SELECT lib, count(*) FILTER (NOT arom) AS plain, count(*) FILTER (z = 6) AS c, count(*) FILTER (z = 8) AS o, count(*) FILTER (ringbonds > 0) AS inside FROM a GROUP BY lib),
kinds AS (SELECT lib, count(*) FILTER (label = 'D') AS d, count(*) FILTER (ring) AS r FROM b1 GROUP BY lib),
found AS (SELECT lib, 1 AS query_id FROM sums JOIN kinds USING (lib) WHERE plain >= 2 AND c >= 1 AND o >= 1 AND d >= 1 UNION ALL SELECT lib, 2 FROM sums JOIN kinds USING (lib) WHERE plain >= 3 AND c >= 3 AND inside >= 3 AND r >= 3)""",
    "query_id::BIGINT AS query_id",
)

_KEYS = """c AS (SELECT lib, atom, z || CASE WHEN arom THEN 'a' ELSE 'A' END || 'd' || degree || 'h' || h AS code FROM a),
d AS (SELECT b.lib, x, y, p.code AS cx, q.code AS cy, label || CASE WHEN ring THEN '@' ELSE '!' END AS bond FROM b JOIN c p ON p.lib = b.lib AND p.atom = x JOIN c q ON q.lib = b.lib AND q.atom = y),
shapes AS (SELECT lib, 'edge' AS family, [cx, bond, cy] AS parts FROM d WHERE x < y
UNION ALL SELECT e.lib, 'path3', [e.cy, e.bond, e.cx, f.bond, f.cy] FROM d e JOIN d f ON f.lib = e.lib AND f.x = e.x AND e.y < f.y
UNION ALL SELECT m.lib, 'path4', [e.cy, e.bond, m.cx, m.bond, m.cy, f.bond, f.cy] FROM d m JOIN d e ON e.lib = m.lib AND e.x = m.x AND e.y <> m.y
  JOIN d f ON f.lib = m.lib AND f.x = m.y AND f.y <> m.x AND f.y <> e.y WHERE m.x < m.y),
keys AS (SELECT lib, family, least(array_to_string(parts, '-'), array_to_string(list_reverse(parts), '-')) AS key FROM shapes
UNION ALL SELECT e.lib, 'star3', e.cx || '-' || array_to_string(list_sort([e.bond || e.cy, f.bond || f.cy, g.bond || g.cy]), '-')
  FROM d e JOIN d f ON f.lib = e.lib AND f.x = e.x AND e.y < f.y JOIN d g ON g.lib = e.lib AND g.x = e.x AND f.y < g.y),
counted AS (SELECT lib, family, key, count(*) AS n FROM keys GROUP BY ALL)"""


def _family(family: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return screen.features(corpus(spark, sf_dir)).where(F.col("family") == family).select("mol_id", "key", "n")

    QUERIES[f"screen_{family}"] = run
    keyed(f"screen_{family}", _KEYS, "key, n", "counted", f"WHERE family = '{family}'")


for _name in screen.FAMILIES[1:]:
    _family(_name)


@query
def screen_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys by joins over atoms and bonds."""
    return screen.joined_features(corpus(spark, sf_dir)).where("family <> 'count'").select("mol_id", "family", "key", "n")


keyed("screen_by_joins", _KEYS, "family, key, n", "counted")


@query
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, index = _index(spark, sf_dir)
    return screen.hits(held, index, _SCREENED)


_HITS = f"""found AS (SELECT 1 AS query_id, lib FROM ({_CARBONYL}) UNION SELECT 2, lib FROM a WHERE z = 6 AND arom
UNION SELECT 3, p.lib FROM {_ACID} WHERE p.z = 6 AND r.z = 6 AND NOT r.arom UNION SELECT 4, lib FROM ({pair_sql(_C, _N, "e.label = 'T'")}) UNION SELECT 5, lib FROM a WHERE z = 6 AND NOT arom AND rings > 0)"""
keyed("hits", _HITS, "query_id::BIGINT AS query_id")


@query
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by all families; for these patterns they are the hits."""
    _, index = _index(spark, sf_dir)
    return screen.candidates(index, screen.requirement_table(spark, _SCREENED[:4])).select("query_id", "mol_id")


keyed("candidates", _HITS, "query_id::BIGINT AS query_id", condition="WHERE query_id < 5")


@query
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _index(spark, sf_dir)
    return screen.candidate_counts(index, screen.requirement_table(spark, [*_SCREENED[:4], (9, "[Pt]")]))


ORACLES["candidate_counts"] = f"""WITH {tables()}, {_HITS}, n AS (SELECT query_id, count(*) AS n FROM part JOIN found ON p_partkey % {SIZE} = lib GROUP BY query_id)
SELECT q.query_id::BIGINT AS query_id, coalesce(n, 0) AS n FROM (VALUES (1), (2), (3), (4), (9)) q(query_id) LEFT JOIN n ON n.query_id = q.query_id"""


def _store(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "store")
    index_store.write(corpus(spark, sf_dir), path, 3)
    return path


@query
def hits_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each stored shard by itself, put together."""
    path = _store(spark, sf_dir)
    first, *rest = [index_store.read(spark, path, [r.shard_id]).hits(_SCREENED) for r in index_store.read(spark, path).shards.collect()]
    for part in rest:
        first = first.union(part)
    return first


ORACLES["hits_sharded"] = ORACLES["hits"]


@query
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shards hold all molecules, none of them twice, in order."""
    held = index_store.read(spark, _store(spark, sf_dir)).shards
    return held.agg(F.count(F.lit(1)).alias("shards"), F.sum("molecules").alias("molecules"), F.min("first").alias("first"), F.max("last").alias("last"))


ORACLES["shards"] = "SELECT 3::BIGINT AS shards, count(*) AS molecules, min(p_partkey) AS first, max(p_partkey) AS last FROM part"


@query
def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from a corpus that was written in shards by hash and read back, two of them."""
    path = new_path(spark, "corpus")
    corpus(spark, sf_dir).write(path, shards=4)
    parts = [match.counts(source.Corpus.read(spark, path, [k]), "C-O", joined=k % 2 == 0) for k in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


ORACLES["stored_corpus"] = counted_sql(pair_sql(_C, _O, "e.label = 'S'"))


@query
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys, index rows, features and labels of each family."""
    return screen.statistics(corpus(spark, sf_dir)).where("family <> 'count'")


ORACLES["index_statistics"] = f"""WITH {tables()}, {_KEYS}, rows_ AS (SELECT family, key, n FROM part JOIN counted ON p_partkey % {SIZE} = lib),
labels AS (SELECT DISTINCT family, unnest(regexp_extract_all(key, '[0-9]+[aA]d[0-9]+h[0-9]+|[SDTAQ][!@]')) AS label FROM rows_),
made AS (SELECT family, count(*) FILTER (regexp_matches(label, '^[0-9]')) AS atom_labels, count(*) FILTER (NOT regexp_matches(label, '^[0-9]')) AS bond_labels FROM labels GROUP BY family)
SELECT family, count(DISTINCT key) AS keys, count(*) AS postings, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, any_value(atom_labels) AS atom_labels, any_value(bond_labels) AS bond_labels FROM rows_ JOIN made USING (family) GROUP BY family"""


@query
def requirement_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rings of n carbons need: n edges, paths of 3 and of 4, each of one kind."""
    needs = screen.requirement_table(spark, [(n, "C1" + "C" * (n - 2) + "C1") for n in range(5, 9)])
    return screen.requirement_statistics(needs.where("family <> 'count'")).select("query_id", "family", "features", "required")


ORACLES["requirement_statistics"] = "SELECT n AS query_id, family, 1::BIGINT AS features, n AS required FROM range(5, 9) t(n), (VALUES ('edge'), ('path3'), ('path4')) f(family)"


@query
def mine_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds, paths of 3 and 4 atoms and stars that stand in enough molecules."""
    return screen.mine(corpus(spark, sf_dir))


ORACLES["mine_shapes"] = f"WITH {tables()}, {_KEYS} SELECT family, key, count(*) AS support FROM part JOIN counted ON p_partkey % {SIZE} = lib GROUP BY family, key HAVING count(*) >= 4"


@query
def mine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most supported of each family."""
    return screen.mine(corpus(spark, sf_dir), top=5)


ORACLES["mine_top"] = f"WITH {tables()}, {_KEYS} SELECT family, key, count(*) AS support FROM part JOIN counted ON p_partkey % {SIZE} = lib GROUP BY family, key HAVING count(*) >= 4 QUALIFY row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, key) <= 5"


@query
def mine_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most supported features as patterns, and in how many molecules these then match: as many as have the feature."""
    held = corpus(spark, sf_dir)
    best = screen.mine(held, top=20).select("family", "key", screen.key_smarts().alias("smarts")).orderBy("family", "key").collect()
    found = match.by_batch(held.packed, [(i, r.smarts) for i, r in enumerate(best)], "exists").groupBy("query_id").agg(F.count(F.lit(1)).alias("matched"))
    names = spark.createDataFrame([(i, r.family, r.key) for i, r in enumerate(best)], "query_id long, family string, key string")
    return names.join(found, "query_id").select("family", "key", "matched")


ORACLES["mine_patterns"] = ORACLES["mine_top"].replace("<= 5", "<= 20").replace("AS support", "AS matched")


@query
def prepare_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no molecules, with what is wrong."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mol_id"))
    texts = F.array(F.lit("CCO"), F.lit(""), F.lit("C("), F.lit("C1CC"))
    made = part.select("mol_id", F.get(texts, (F.col("mol_id") % 4).cast("int")).alias("smiles"))
    return source.from_smiles(made).errors.select("mol_id", "error")


ORACLES["prepare_errors"] = "SELECT p_partkey AS mol_id, CASE WHEN p_partkey % 4 = 1 THEN 'empty_target' ELSE 'invalid_target_smiles' END AS error FROM part WHERE p_partkey % 4 > 0"


@query
def prepared_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived columns of every atom."""
    columns = ["z", "aromatic", "charge", "degree", "total_h", "ring_count", "min_ring", "ring_bonds", "hetero", "component"]
    return corpus(spark, sf_dir).atoms.select("mol_id", "atom_id", *columns)


ORACLES["prepared_atoms"] = f"WITH {tables()} SELECT p_partkey AS mol_id, atom AS atom_id, z, arom AS aromatic, charge, degree::INT AS degree, h AS total_h, rings::INT AS ring_count, minring AS min_ring, ringbonds::INT AS ring_bonds, hetero::INT AS hetero, component FROM part JOIN a ON p_partkey % {SIZE} = lib"


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ring of 3 to 6 atoms for each row of part, and for every tenth a loop more."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mol_id"), (F.col("p_partkey") % 4 + 3).cast("int").alias("n"))
    atoms = part.select("mol_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("atom_id"))
    ring = atoms.select("mol_id", F.col("atom_id").alias("a"), F.pmod(F.col("atom_id") + 1, F.col("n")).alias("b"), F.lit("S").alias("label"))
    loops = part.where("mol_id % 10 = 0").select("mol_id", F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit("S").alias("label"))
    return atoms.select("mol_id", "atom_id"), ring.union(loops)


@query
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings, paths and bonds of graphs without elements."""
    return match.by_batch(source.corpus_of_graphs(*_graphs(spark, sf_dir)).packed, [(0, "*1~*~*1"), (1, "*~*~*"), (2, "*@*"), (3, "[R]")])


ORACLES["graph_counts"] = """WITH g AS (SELECT p_partkey AS mol_id, p_partkey % 4 + 3 AS n FROM part WHERE p_partkey % 10 <> 0),
found AS (SELECT mol_id, unnest(range(4)) AS query_id, unnest([(n = 3)::BIGINT, CASE WHEN n = 3 THEN 1 ELSE n END, n, n]) AS n FROM g)
SELECT mol_id, query_id, n FROM found WHERE n > 0"""


@query
def graph_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.corpus_of_graphs(*_graphs(spark, sf_dir)).errors.select("mol_id", "error")


ORACLES["graph_errors"] = "SELECT p_partkey AS mol_id, 'self_loop' AS error FROM part WHERE p_partkey % 10 = 0"


@query
def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of generic graphs that are not good: loops, unknown ends and repeats."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mol_id"))
    atoms = part.select("mol_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("atom_id"))
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 1), (1, 7), (0, 2), (2, 0))])
    bonds = part.select("mol_id", F.explode(ends).alias("e")).select("mol_id", "e.a", "e.b", F.lit("S").alias("label"))
    return source.from_graphs(atoms, bonds)[1].select("mol_id", "a", "b", "error")


ORACLES["graph_scan"] = "SELECT p_partkey AS mol_id, a, b, error FROM part, (VALUES (1, 1, 'self_loop'), (1, 7, 'unknown_atom'), (0, 2, 'duplicate_bond'), (2, 0, 'duplicate_bond')) AS e(a, b, error)"


@query
def stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules that come as a stream, against a fixed set of patterns; all that is there is taken once."""
    inside, out, at = (new_path(spark, name) for name in ("stream-in", "stream-out", "stream-state"))
    molecules(spark, sf_dir).write.parquet(inside)
    stream = spark.readStream.schema("mol_id long, smiles string").parquet(inside)
    found = streaming.matched(stream, _SCREENED).select("mol_id", "query_id")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("mol_id long, query_id long").parquet(out)


ORACLES["stream_matches"] = ORACLES["hits"]


@query
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows, by a table function."""
    register(spark)
    molecules(spark, sf_dir).createOrReplaceTempView("graphsieve_molecules")
    return spark.sql("SELECT m.mol_id, e.place, e.atoms[0] AS c, e.atoms[1] AS o FROM graphsieve_molecules m, LATERAL smiles_embeddings(m.smiles, 'C-O') e")


keyed("table_function", f"{_SINGLE_CO}, found AS (SELECT lib, (row_number() OVER (PARTITION BY lib ORDER BY least(c, o), greatest(c, o)) - 1)::INT AS place, c, o FROM hits)", "place, c, o")
