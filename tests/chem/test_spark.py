"""The same answers by joins and by the kernel, screening, storage, SQL functions and a stream."""

import duckdb
import pytest

from graphsieve.chem.perception import prepare
from graphsieve.functions import sql
from graphsieve.operators import match, screen
from graphsieve.plans import joins
from graphsieve.plans.kernel import Matcher
from graphsieve.queries import chem
from graphsieve.queries.library import MOLECULES as LIBRARY
from graphsieve.queries.library import tables as tables_sql
from graphsieve.smarts.query import parse
from graphsieve.sources import tables
from graphsieve.streaming.match import matched
from tests.conftest import SF

SMILES = ["CCO", "CC(=O)O", "c1ccccc1O", "CC(N)C(=O)O", "C1CC1C=O", "[Na+].[Cl-].CC", "O=C(O)c1nc(O)ccn1", "[13CH4]", "[2H]Cl", "bad(", "", None, "c1ccc2[nH]ccc2c1", "CC(=O)O"]
PATTERNS = ["C=O", "[C;!$(C=O)]O", "c1ccccc1", "(C).(Cl)", "[!#6]", "C(=O)[O;H,-]", "[$(C[$(C=O)])]", "F/C=C/F", "C.O.O", "(C.O)", "[$(C.Cl)]", "CC(=O)O"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    tables.from_smiles(spark.createDataFrame(list(enumerate(SMILES)), "mol_id long, smiles string")).write(path, shards=3)
    return tables.Corpus.read(spark, path)


def good():
    for i, s in enumerate(SMILES):
        if s and s != "bad(":
            yield i, prepare(s)


@pytest.mark.parametrize("smarts", PATTERNS)
@pytest.mark.parametrize("joined", [False, True])
def test_joins_batches_and_kernel_agree(corpus, smarts, joined):
    matcher = Matcher.of(smarts)
    want = {i: matcher.unique(m) for i, m in good() if matcher.matches(m)}
    assert {r.mol_id: r.embeddings for r in match.embeddings(corpus, smarts, joined).collect()} == want
    assert {r.mol_id: r.n for r in match.counts(corpus, smarts, joined).collect()} == {i: len(e) for i, e in want.items()}
    assert [r.mol_id for r in match.exists(corpus, parse(smarts), joined).orderBy("mol_id").collect()] == sorted(want)
    assert {r.mol_id: round(r.coverage, 9) for r in match.coverage(corpus, smarts, joined).collect()} == {i: round(matcher.outcome(m).coverage, 9) for i, m in good()}


def test_thresholds(corpus):
    needs = [(1, "C", 2), (2, "[#8]", 2), (3, "N", 0), (4, "c", 6)]
    want = {(i, k) for i, m in good() for k, s, n in needs if Matcher.of(s).count(m) >= n}
    assert sorted(map(tuple, match.at_least(corpus, needs).collect())) == sorted(want)


def test_joins_stay_on_the_jvm(corpus):
    found = joins.embeddings(corpus, parse("CC(=O)O"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "PushedFilters" in plan


def test_deadline_and_errors(spark, corpus):
    found = match.by_kernel(spark.createDataFrame([(1, "C" * 30)], "mol_id long, smiles string"), [(1, ".".join("*" * 8))], seconds=0.05).collect()
    assert found[0].exceeded and found[0].matched is None
    assert {r.mol_id: r.error for r in corpus.errors.collect()} == {9: "invalid_target_smiles", 10: "empty_target", 11: "empty_target"}


def test_candidates_hold_every_hit(spark, corpus):
    index = screen.features(corpus)
    patterns = list(enumerate(PATTERNS[:-1]))
    exact = {(q, i) for q, s in patterns for i, m in good() if Matcher.of(s).matches(m)}
    found = {tuple(r) for r in screen.candidates(index, screen.requirement_table(spark, patterns)).select("query_id", "mol_id").collect()}
    counts = {tuple(r) for r in screen.may_match(index, screen.requirement_table(spark, patterns)).select("query_id", "mol_id").collect()}
    assert exact <= found <= counts
    assert {tuple(r) for r in screen.hits(corpus, index, patterns).select("query_id", "mol_id").collect()} == exact
    assert screen.statistics(index).count() == 5


def test_functions_in_sql(spark):
    sql.register(spark)
    r = spark.sql("SELECT smiles_match('CCO', 'CO') AS a, smiles_match_count('CCC', 'CC') AS b, smarts_error_code('C1') AS c, smarts_canonical('OC') = smarts_canonical('CO') AS d, smiles_match('C(', 'C') AS e, smarts_valid(NULL) AS f").first()
    assert tuple(r) == (True, 2, "unclosed_ring_closure", True, None, None)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "CCO"), (2, "CC")], "mol_id long, smiles string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mol_id long, smiles string").parquet(str(tmp_path / "in"))
    q = matched(stream, [(7, "O"), (8, "C")]).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT mol_id, query_id FROM found").collect())) == [(1, 7), (1, 8), (2, 8)]


def test_read_patterns(spark, tmp_path):
    (tmp_path / "p.smarts").write_text("CO\n\n# note\n C=O \n")
    assert {r.smarts for r in tables.read_patterns(spark, str(tmp_path / "p.smarts")).collect()} == {"CO", "C=O"}


@pytest.mark.parametrize("name", list(chem.QUERIES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    want = con.execute(chem.ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    got = chem.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    exact = lambda rows: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert exact(map(tuple, got.select(names).collect())) == exact(want)


def test_library_by_perception_and_by_tables():
    """The columns that are derived from the texts are those that are put together from the parts' tables."""
    rows = duckdb.sql(f"WITH {tables_sql()} SELECT lib, atom, z, arom, charge, h, component, isotope, degree, rings, minring, ringbonds, hetero FROM a ORDER BY lib, atom").fetchall()
    made = [
        (n, i, m.z[i], m.aromatic[i], m.charge[i], m.total_h[i], m.component[i], m.isotope[i] or 0, m.degree[i], m.ring_count[i], m.min_ring[i], m.ring_bonds[i], m.hetero[i])
        for n, m in enumerate(map(prepare, LIBRARY)) for i in range(len(m))
    ]
    assert rows == made and len(set(LIBRARY)) == 2000


def test_mining_counts_each_shape_once_a_molecule(spark):
    """Shapes in fewer than four molecules are left out."""
    held = tables.from_smiles(spark.createDataFrame(list(enumerate(["CCCO", "OCCC"] * 2 + ["CC(F)Cl"] * 4 + ["CC(F)Br"] * 3)), "mol_id long, smiles string"))
    want = {("edge", "6Ad1h3-S!-6Ad2h2"): 4, ("edge", "6Ad2h2-S!-6Ad2h2"): 4, ("edge", "6Ad2h2-S!-8Ad1h1"): 4, ("edge", "6Ad1h3-S!-6Ad3h1"): 7, ("edge", "6Ad3h1-S!-9Ad1h0"): 7, ("edge", "17Ad1h0-S!-6Ad3h1"): 4}
    want |= {("path3", "6Ad1h3-S!-6Ad2h2-S!-6Ad2h2"): 4, ("path3", "6Ad2h2-S!-6Ad2h2-S!-8Ad1h1"): 4, ("path3", "6Ad1h3-S!-6Ad3h1-S!-9Ad1h0"): 7, ("path3", "17Ad1h0-S!-6Ad3h1-S!-6Ad1h3"): 4, ("path3", "17Ad1h0-S!-6Ad3h1-S!-9Ad1h0"): 4}
    want |= {("path4", "6Ad1h3-S!-6Ad2h2-S!-6Ad2h2-S!-8Ad1h1"): 4, ("star3", "6Ad3h1-S!17Ad1h0-S!6Ad1h3-S!9Ad1h0"): 4}
    assert {(r.family, r.key): r.support for r in screen.mine(screen.features(held)).collect()} == want


def test_index_shards(spark, corpus, tmp_path):
    from graphsieve.sources import index_store

    path = str(tmp_path / "index")
    store = index_store.write(corpus, path, 3)
    assert store.shards.count() == 3 and store.shards.agg({"molecules": "sum"}).first()[0] == corpus.packed.count()
    patterns = list(enumerate(PATTERNS))
    index = screen.features(corpus)
    whole = sorted(map(tuple, screen.candidates(index, screen.requirement_table(spark, patterns)).collect()))
    assert sorted(map(tuple, store.candidates(patterns).collect())) == whole
    assert {r.query_id: r.n for r in store.candidate_counts(patterns).collect()} == {q: sum(k == q for k, _ in whole) for q, _ in patterns}
    parts = [index_store.read(spark, path, [k]) for k in range(3)]
    assert sorted(tuple(r) for p in parts for r in p.candidates(patterns).collect()) == whole
    exact = sorted((q, i) for q, s in patterns for i, m in good() if Matcher.of(s).matches(m))
    assert sorted(map(tuple, store.hits(patterns).collect())) == exact == sorted(tuple(r) for p in parts for r in p.hits(patterns).collect())
    with pytest.raises(ValueError, match="no shards"):
        index_store.read(spark, path, [7])
    store.shards.withColumn("first", store.shards["first"] - 100).write.parquet(str(tmp_path / "bad" / "shards"))
    with pytest.raises(ValueError, match="overlap"):
        index_store.read(spark, str(tmp_path / "bad"))


def test_features_by_joins_and_by_batches(corpus):
    assert sorted(map(tuple, screen.features(corpus).collect())) == sorted(map(tuple, screen.joined_features(corpus).select("mol_id", "family", "key", "n").collect()))


def test_mined_patterns_match_their_support(spark, corpus):
    index = screen.features(corpus)
    for r in screen.mined_patterns(index, least=2).collect():
        assert sum(Matcher.of(r.smarts).matches(m) for _, m in good()) >= r.support
    kept = screen.mine(index, least=1, top=2).collect()
    every = screen.mine(index, least=1).collect()
    for family in {r.family for r in every}:
        best = sorted((-r.support, r.key) for r in every if r.family == family)[:2]
        assert sorted((-r.support, r.key) for r in kept if r.family == family) == best


def test_statistics(spark, corpus):
    held = {(r.mol_id, r.family, r.key): r.n for r in screen.features(corpus).collect()}
    for r in screen.statistics(screen.features(corpus)).collect():
        own = {k: n for k, n in held.items() if k[1] == r.family}
        keys = {k[2] for k in own}
        labels = {x for k in keys for x in ([k.split("-")[0], *(y for arm in k.split("-")[1:] for y in (arm[:2], arm[2:]))] if r.family == "star3" else k.split("-"))} if r.family != "count" else set()
        assert (r.keys, r.postings, r.total, r.most) == (len(keys), len(own), sum(own.values()), max(own.values()))
        assert (r.atom_labels, r.bond_labels) == (sum(x[0].isdigit() for x in labels), sum(not x[0].isdigit() for x in labels))
    needs = screen.requirement_table(spark, [(1, "C1CC1"), (2, "C")])
    found = {(r.query_id, r.family): (r.features, r.required) for r in screen.requirement_statistics(needs).collect()}
    assert found[1, "edge"] == (1, 3) and found[1, "path3"] == (1, 3) and (2, "edge") not in found
    assert {r.key for r in needs.where("query_id = 1 AND family = 'count'").collect()} >= {"bond_ring", "atom_ring"}


def test_joins_of_a_local_corpus_need_no_shuffle(spark, corpus):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    held = corpus.local(4)
    held.atoms.count(), held.bonds.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = match.counts(held, "CC(=O)[O;H1,-]", joined=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ENSURE_REQUIREMENTS") == 0
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in match.counts(corpus, "CC(=O)[O;H1,-]").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
        held.atoms.unpersist()
        held.bonds.unpersist()


def test_bonds_of_graphs_are_judged_without_broadcasts(spark):
    """Ends and repeats are looked up by sorted joins: the driver holds none of them. A bond without ends is in error, not left out."""
    atoms = spark.range(200).selectExpr("id AS mol_id", "explode(array(0, 1, 2)) AS atom_id")
    bonds = spark.range(200).selectExpr("id AS mol_id", "explode(array((0, 1), (1, 1), (1, 7), (0, 2), (2, 0), (CAST(NULL AS INT), NULL))) AS e", "'S' AS label").selectExpr("mol_id", "e.col1 AS a", "e.col2 AS b", "label")
    good, bad = tables.from_graphs(atoms, bonds)
    assert sorted(map(tuple, good.collect())) == [(k, 0, 1, "S") for k in range(200)]
    want = [(1, 1, "self_loop"), (1, 7, "unknown_atom"), (0, 2, "duplicate_bond"), (2, 0, "duplicate_bond"), (None, None, "unknown_atom")]
    assert {tuple(r) for r in bad.select("mol_id", "a", "b", "error").collect()} == {(k, *w) for k in range(200) for w in want}
    for found in (good, bad):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def _many(spark):
    return spark.range(0, 400, 1, 1).selectExpr("id AS mol_id", "element_at(array('CCO', 'CC(=O)O', 'c1ccccc1O', 'C#N'), CAST(id % 4 AS INT) + 1) AS smiles")


def _most_in_a_task(df):
    """The most distinct mol_id of a partition."""
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("mol_id").alias("n")).agg({"n": "max"}).first()[0]


def test_molecules_of_one_file_are_dealt_to_many_tasks(spark, monkeypatch):
    """Few bytes of ids unfold to many atoms; what is grouped by molecule then needs no further exchange."""
    monkeypatch.setattr(tables, "MOLECULES", 20)
    held = tables.from_smiles(_many(spark))
    for df in (held.packed, held.atoms, held.bonds, screen.features(held)):
        assert _most_in_a_task(df.select("mol_id")) < 60
    found = match.counts(held, "*", joined=True)
    assert {r.mol_id: r.n for r in found.collect()} == {k: (3, 4, 7, 2)[k % 4] for k in range(400)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_candidates_are_summed_in_shares(spark, monkeypatch):
    """Index rows are dealt by molecule once, so many to a task, and summed there only."""
    monkeypatch.setattr(screen, "POSTINGS", 50)
    index = screen.features(tables.from_smiles(_many(spark)))
    found = screen.candidates(index, screen.requirement_table(spark, [(1, "C=O"), (2, "c"), (3, "[Pt]")]))
    assert sorted(map(tuple, found.collect())) == [(q, k) for q, own in ((1, 1), (2, 2)) for k in range(400) if k % 4 == own]
    assert _most_in_a_task(found) < 60
    assert screen.candidates(index, screen.requirement_table(spark, [(3, "[Pt]")])).count() == 0


def test_shards_are_written_by_tasks_of_few_molecules(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from graphsieve.sources import index_store

    monkeypatch.setattr(index_store, "MOLECULES", 20)
    store = index_store.write(tables.from_smiles(_many(spark)), str(tmp_path / "store"), 2)
    for df in (store.postings, store.packed):
        assert df.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("mol_id").alias("n")).agg({"n": "max"}).first()[0] < 60
    assert [r.molecules for r in store.shards.orderBy("shard_id").collect()] == [200, 200]
    assert [index_store.read(spark, str(tmp_path / "store"), own).share for own in (None, [0], [1])] == [1.0, 0.5, 0.5]
    found = [tuple(r) for k in (0, 1) for r in index_store.read(spark, str(tmp_path / "store"), [k]).hits([(1, "C=O"), (2, "c")]).collect()]
    assert sorted(found) == [(q, k) for q, own in ((1, 1), (2, 2)) for k in range(400) if k % 4 == own]


def test_dictionary_of_a_corpus_needs_no_index(spark, tmp_path):
    """What is summed from distinct texts with their numbers, from packed rows, and by joins is what the index has."""
    bad = [(400 + k, text) for k, text in enumerate(["C(", None, "", "C(", "[Na+].[Cl-]", "C"])]
    held = tables.from_smiles(_many(spark).union(spark.createDataFrame(bad, "mol_id long, smiles string")))
    want = sorted(map(tuple, screen.dictionary(screen.features(held)).collect()))
    assert {r[:2]: r[2:] for r in want}["count", "atoms"] == (402, 1603, 7)
    held.write(str(tmp_path / "corpus"))
    for corpus in (held, tables.Corpus.read(spark, str(tmp_path / "corpus")), tables.Corpus(held.molecules, held.atoms, held.bonds, held.errors)):
        assert sorted(map(tuple, screen.dictionary(corpus).collect())) == want
    none = tables.from_smiles(spark.createDataFrame([], "mol_id long, smiles string"))
    assert screen.dictionary(none).count() == 0 and held.texts.agg({"molecules": "sum"}).first()[0] == 402 and held.texts.count() == 6


def test_mining_reads_each_text_once(spark, tmp_path):
    """Ten times the molecules with the same texts are ten times the support, from no more rows than there are texts."""
    from pyspark.sql import functions as F

    for k in (1, 10):
        part = spark.read.parquet(f"{SF}/part.parquet").crossJoin(spark.range(k)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 2000)
        part.drop("id").write.parquet(str(tmp_path / str(k) / "part.parquet"))
    for name in ("mine_shapes", "mine_top"):
        once, tenfold = (chem.QUERIES[name](spark, str(tmp_path / str(k))) for k in (1, 10))
        assert {(r.family, r.key): 10 * r.support for r in once.collect()}.items() <= {(r.family, r.key): r.support for r in tenfold.collect()}.items()
        assert spark.read.parquet(*tenfold.inputFiles()).count() <= 200
