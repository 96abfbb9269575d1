"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import collections
import hashlib
import math

import numpy as np
import pytest

import corpus_pipeline
from graphsieve.llm import lines, minhash, mixing, packing, pairwise, queries
from tests.conftest import SF
from tests.llm import oracles as o


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(name, docs before, docs after) of every stage."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(steps):
    assert [name for name, _, _ in steps] == ["quality_classifier", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    for _, before, after in steps[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.dtypes == before.dtypes


def test_classifier_keeps_good_documents(spark, steps):
    _, before, after = steps[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert all(labels[i] == 0 for i in labels if i not in kept) and sum(labels[i] == 0 for i in kept if i in labels) <= 1
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_lines(steps):
    _, before, after = steps[1]
    sites = collections.defaultdict(set)
    rows = {r.doc_id: r for r in before.collect()}
    for r in rows.values():
        for line in r.text.split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(r.source)
    bad = {k for k, s in sites.items() if len(s) >= lines.LEAST_SITES}
    for r in after.collect():
        every = rows[r.doc_id].text.split("\n")
        kept = [x for x in every if x.strip(" ") not in bad]
        assert r.text == ("\n".join(kept) if any(x.strip(" ") for x in kept) else rows[r.doc_id].text)


def test_lines_go_from_documents_of_mostly_boilerplate(spark):
    notice = "We use cookies and similar means to make this site work for all of its readers"
    given = [(i, f"own words {i}\n{notice}", "en", f"s{i}", 90) for i in range(12)] + [(99, f"{notice}\n", "en", "s1", 80)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert got == {i: (f"own words {i}", len(f"own words {i}")) for i in range(12)} | {99: (f"{notice}\n", 80)}


def test_near_dedup(steps):
    _, before, after = steps[2]
    root = o.near_duplicates([(r.doc_id, r.text) for r in before.collect()], 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted({root[i] for i in root})


def test_near_dedup_keeps_other_texts_of_a_repeated_id(spark):
    words = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    given = [(1, words["a"]), (5, words["a"] + " more"), (5, words["b"]), (5, words["c"]), (5, words["c"]), (6, words["b"]), (7, words["d"]), (7, words["d"] + " more"), (None, words["d"]), (8, ""), (8, ""), (8, None)]
    kept = minhash.one_of_each_group(spark.createDataFrame(given, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([given[0], given[2], given[3], given[6], given[8], given[9], given[11]], key=repr)


def test_mixing_and_packing(steps):
    _, before, mixed = steps[3]
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in before.collect()}
    pieces = steps[4][2].collect()
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    whole = collections.defaultdict(int)
    size = {}
    for p in pieces:
        whole[p.doc_id] += p.length
        size[p.doc_id] = p.doc_tokens
    assert {i: n * size[i] for i, n in copies.items()} == whole
    assert max(np.bincount(np.unique([p.sequence_id for p in pieces], return_inverse=True)[1], [p.length for p in pieces])) <= 2048


def test_run_is_the_stages_in_turn(spark, steps):
    got = collections.Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect())
    want = collections.Counter()
    for r in steps[-1][2].collect():
        want[r.doc_id] += r.length
    total = collections.Counter()
    for (i, _, length), n in got.items():
        total[i] += length * n
    assert total == want


def test_stages_take_awkward_rows(spark):
    docs = spark.createDataFrame([r[:5] for r in o.AWKWARD], ", ".join(o.COLUMNS.split(", ")[:5]))
    kept = minhash.one_of_each_group(docs, width=2)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(8) == 1 and ids.count(None) == 2 and 10 not in ids and 9 in ids and 6 not in ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_each_stage_on_awkward_rows(spark):
    """Every stage gets the awkward rows themselves, and gives the result that it states."""
    docs = spark.createDataFrame([r[:5] for r in o.AWKWARD], ", ".join(o.COLUMNS.split(", ")[:5])).repartition(3)
    rows = collections.Counter(map(tuple, docs.collect()))
    stage = dict(corpus_pipeline.STAGES)
    counted = lambda df: collections.Counter(map(tuple, df.collect()))

    model = pairwise.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.LABELLED)
    numbered = list(rows)
    scores = {r.doc_id: r.score for r in pairwise.scores(spark.createDataFrame([(i, r[1]) for i, r in enumerate(numbered)], "doc_id long, text string"), model).collect()}
    assert counted(stage["quality_classifier"](spark, docs, SF)) == collections.Counter({r: rows[r] for i, r in enumerate(numbered) if o.words(r[1]) and scores[i] >= pairwise.CUT})

    assert counted(stage["line_dedup"](spark, docs, SF)) == rows

    root = o.near_duplicates([(i, t) for i, t in {(r[0], r[1]) for r in rows}], 5)
    want = collections.Counter({r: (1 if r[0] is not None else n) for r, n in rows.items() if r[0] is None or root[r[0]] == r[0]})
    assert counted(stage["near_dedup"](spark, docs, SF)) == want

    site = lambda r: r[3] or ""
    n = collections.Counter()
    for r, times in rows.items():
        n[site(r)] += times
    weights = {s: k**mixing.TEMPERATURE for s, k in n.items()}
    mixed = collections.Counter()
    for r, times in rows.items():
        rate = weights[site(r)] / sum(weights.values()) * sum(n.values()) / n[site(r)]
        key = str(r[0]) if r[0] is not None else "text " + hashlib.md5((r[1] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        copies, below = 0, math.exp(-rate)
        while below <= u:
            copies += 1
            below += math.exp(copies * math.log(rate) - rate - math.lgamma(copies + 1))
        mixed[r] += copies * times
    assert counted(stage["mix_sources"](spark, docs, SF)) == +mixed

    packed = collections.defaultdict(int)
    for p in stage["pack_sequences"](spark, docs, SF).collect():
        packed[p.doc_id] += p.length
    tokens = collections.defaultdict(int)
    encode = packing.encoder_of(queries.TOKENIZER).tokenizer.encode
    for r, times in rows.items():
        tokens[r[0]] += times * (len(encode(r[1] or "", add_special_tokens=False).ids) + 1)
    assert packed == tokens


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
