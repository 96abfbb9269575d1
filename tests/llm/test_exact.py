"""Queries and operators against brute force, on small whole tables and on awkward rows."""

import collections
import hashlib
import math
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.llm import fingerprints, groups, licenses, lines, minhash, mixing, notices, packing, pairwise, passages, queries, stats, trees, warc
from graphsieve.llm.groups import components
from tests.conftest import SF
from tests.llm import oracles as o


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(o.AWKWARD, o.COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], o.COLUMNS)


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, awkward, empty, width):
    for table in (docs, awkward):
        given = [(r.doc_id, r.text) for r in table.collect()]
        root = o.near_duplicates(given, width)
        want = [(i, len(o.shingles(t, width)), root.get(i), i is None or root[i] == i) for i, t in given]
        assert rows(minhash.near_duplicates(table, width=width), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Neighbours are linked, ends are not; some never share a leader."""
    base = [f"w{i}" for i in range(400)]
    given = [(k, " ".join(base[: 400 - 0] if k == 0 else [*[f"x{j}" for j in range(8 * k)], *base[8 * k :]])) for k in range(40)]
    table = spark.createDataFrame(given, "doc_id long, text string")
    root = o.near_duplicates(given, 2)
    assert rows(minhash.near_duplicates(table, width=2), "doc_id", "component_id") == sorted(root.items(), key=repr)
    assert len(set(root.values())) == 1


def test_superminhash_estimates_and_stops(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    s = minhash.superminhash(np.concatenate([a, b, a[:3]]), np.array([0, 3000, 6000, 6003, 6003]), 180)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
    assert (s[2] >> np.uint64(48)).max() < 180 and (s[3] == np.iinfo(np.uint64).max).all()
    assert (minhash.superminhash(a[:3], np.array([0, 3]), 180)[0] == s[2]).all()


@pytest.mark.parametrize("small", [groups.SMALL, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(groups, "SMALL", small)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert rows(components(spark.createDataFrame(edges, "a long, b long").repartition(5)), "v", "root") == sorted(((v, find(v)) for v in parent), key=repr)


def test_components_of_a_hub(spark, monkeypatch):
    """A vertex with 100,000 neighbours, some of which go on to others, by shuffles only."""
    monkeypatch.setattr(groups, "SMALL", 0)
    edges = spark.range(100_000).select(F.lit(500_000).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(0, 100_000, 50).select("id", (F.col("id") + 1_000_000)))
    r = components(edges.repartition(7)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("v"), F.max("root").alias("root")).first()
    assert tuple(r) == (102_001, 102_001, 0)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """Buckets of several groups are compared in blocks of a few members each, and by shuffled contraction."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(groups, "SMALL", 0)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    given = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = f"x{k}y{at}"
        given.append((k, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(4), width=2)
    assert rows(found, "doc_id", "component_id") == sorted(o.near_duplicates(given, 2).items(), key=repr)


def test_warc(spark):
    pages = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, None), (4, "u\r\nv", "short"), (5, "http://c", "short"), (None, "http://d", "x" * 200), (1, "http://a", "x" * 200), (6, "http://e", "é\r\n\r\n" * 60), (7, "", ""), (8, "http://f", "<p>long page</p>" * 300_000), (9, "http://g", "<p>long page</p>" * 300_000)]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    assert rows(warc.round_trip(table), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(o.warc_rows(pages), key=repr)
    assert warc.round_trip(table.where("false")).count() == 0
    whole = spark.read.parquet(f"{SF}/pages.parquet")
    assert rows(queries.op3_warc(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(o.warc_rows([tuple(r) for r in whole.select("page_id", "url", "html").collect()]), key=repr)


def test_warc_selection(spark):
    from graphsieve.llm.store import new_path

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = new_path(spark, "test-warc")
    index = warc.write(pages, path, file_bytes=20_000)
    assert index.select("file").distinct().count() > 1
    wanted = index.where("page_id % 7 = 0")
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read(wanted, path, range_bytes=8192, gap_bytes=100).collect() if r.payload is not None}
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert got and all(html[k] == v for k, v in got.items())
    assert warc.read(index, path, range_bytes=8192).rdd.getNumPartitions() > 4 > warc.read(wanted.limit(1), path).rdd.getNumPartitions()


def test_licenses(docs, awkward, empty):
    for table in (docs, awkward):
        got = licenses.scan(table)
        assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((r.doc_id, *o.base_licenses(r.text)) for r in table.collect()), key=repr)
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert (r.score > 0) == bool(r.labels)
    assert licenses.scan(empty).count() == 0


def test_notices(spark):
    text = "x y Z. This work is licensed under the GNU General Public License, version 3. More words follow."
    table = spark.createDataFrame([(1, text), (2, "general words, public places, license plates"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(table).collect()} == {1: "gpl-3", 2: "", 3: "mit"}


def test_notices_by_brute_force(spark, docs, awkward):
    """Whole licences, with words left out, changed and put in, between other text, and the tables."""
    rng = np.random.default_rng(9)
    filler = [r.text for r in docs.limit(30).collect()]
    given = []
    for n, (_, text, _) in enumerate((*notices.NAMED, *notices.FULL) * 3):
        words = text.split()
        for _ in range(int(rng.integers(0, 3)) * (n % 3)):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 2))] = ["Copyright", "Someone"][: int(rng.integers(0, 3))]
        given.append((n, f"{filler[n % 30][:300]}\n{' '.join(words)}\n{filler[(n + 1) % 30][:200]}"))
    for table in (spark.createDataFrame(given, "doc_id long, text string"), docs, awkward):
        want = o.licence_labels([(r.doc_id, r.text) for r in table.collect()], licenses.NOTICES, licenses.ANCHORS, licenses.SPACING, licenses.AGREE, licenses.SLACK, licenses.LEAST)
        assert rows(licenses.scan(table), "doc_id", "labels", "score") == sorted(want, key=repr)
    clean = o.licence_labels([(i, text) for i, (_, text, _) in enumerate((*notices.NAMED, *notices.FULL))], licenses.NOTICES, 4, 20, 2, 2, 0.7)
    assert all(label in found.split(",") for (label, _, _), (_, found, _) in zip((*notices.NAMED, *notices.FULL), clean, strict=True))


def _sketches(spark, texts):
    """Of each text the least hashes of its distinct shingles, which are taken in Python and hashed one by one."""
    texts = sorted(texts)
    flat = [(n, list(run)) for n, t in enumerate(texts) for run in o.shingles(t.lower(), fingerprints.WIDTH)]
    one = F.transform("w", lambda x: F.xxhash64(x))
    of_run = F.when(F.size("w") == fingerprints.WIDTH, F.xxhash64(*[F.get(one, i) for i in range(fingerprints.WIDTH)])).otherwise(F.xxhash64(one))
    out = collections.defaultdict(set)
    for r in spark.createDataFrame(flat, "n long, w array<string>").select("n", of_run.alias("h")).collect():
        out[r.n].add(r.h)
    return {t: sorted(out[n])[: fingerprints.K] for n, t in enumerate(texts)}


def _alike(a, b):
    """Resemblance and containment of a in b by two sketches, and a's number of shingles, as estimated."""
    k = fingerprints.K
    count = lambda s: len(s) if len(s) < k else (k - 1) / ((s[-1] + 2.0**63) / 2.0**64)
    u = sorted({*a, *b})[:k]
    if not u:
        return 1.0, 1.0, 0.0
    share = len(set(u) & set(a) & set(b)) / len(u)
    return share, min(1.0, share * count(u) / max(count(a), 1)), float(count(a))


def test_fingerprints(spark, docs, awkward, empty):
    for table, ranges in ((docs, 8192), (docs, 7), (awkward, 2), (awkward.where("doc_id IS NULL"), 2), (docs.limit(1), 1)):
        given = [(r.doc_id, r.text or "") for r in table.collect()]
        least = {}
        for i, t in sorted((i, t) for i, t in given if i is not None):
            least.setdefault(i, t)
        ring = sorted(least, reverse=True)
        after = {i: least[ring[(k + 1) % len(ring)]] for k, i in enumerate(ring)} | {None: least[ring[0]] if ring else ""}
        edited = {(i, t): t[: len(t) - len(t) // 2] + after[i][: len(t) // 2] for i, t in given}
        sketch = _sketches(spark, {*edited.values(), *after.values(), *(t for _, t in given)})
        text = lambda s: "".join(f"{h + (1 << 63):016X}" for h in s)
        want = []
        for i, t in given:
            own, other = sketch[t], sketch[edited[i, t]]
            to_edited, to_next = _alike(own, other), _alike(own, sketch[after[i]])
            want.append((i, len(t), hashlib.sha256(edited[i, t].encode()).hexdigest(), text(own), text(other), to_edited[0], to_next[0], to_edited[1], to_next[1], to_edited[2]))
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited", "contained_in_next", "shingles"]
        got = rows(fingerprints.with_edits(table, rows=ranges), *names)
        assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=repr)]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in sorted(want, key=repr)])
    assert fingerprints.with_edits(empty).count() == 0


def test_fingerprints_of_whole_sets(docs):
    """Estimates against the shingle sets themselves."""
    given = {r.doc_id: o.shingles((r.text or "").lower(), fingerprints.WIDTH) for r in docs.collect()}
    ring = sorted(given, reverse=True)
    for r in fingerprints.with_edits(docs).collect():
        a, b = given[r.doc_id], given[ring[(ring.index(r.doc_id) + 1) % len(ring)]]
        true = len(a & b) / len(a | b) if a or b else 1.0
        assert abs(r.near_next - true) < (0.2 if len(a | b) > fingerprints.K else 1e-9)
        assert abs(r.shingles - len(a)) <= (0.4 * len(a) if len(a) >= fingerprints.K else 0)


def test_fingerprints_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500, 4500))
    table = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    r = table.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.merge(F.col("a"), F.col("b")).alias("m"), (fingerprints.from_text(fingerprints.to_text(F.col("a"))) == F.col("a")).alias("same")).first()
    assert abs(r.j - 1 / 3) < 0.13 and abs(r.c - 0.5) < 0.2 and abs(r.n / 2996 - 1) < 0.3 and r.same
    parts = table.select(F.lit("k").alias("k"), F.explode(F.array("a", "b")).alias("s"))
    assert fingerprints.merged(parts, "k", "s").first().s == r.m


def test_fingerprints_merge_of_empty_parts(spark):
    parts = spark.createDataFrame([("a", []), ("a", []), ("b", []), ("b", [7, 9]), ("b", [3, 7]), ("c", None), (None, [5]), (None, [])], "k string, s array<bigint>")
    assert rows(fingerprints.merged(parts, "k", "s", k=2), "k", "s") == sorted([("a", []), ("b", [3, 7]), ("c", []), (None, [5])], key=repr)


def test_mixing(spark, awkward, empty):
    got = mixing.mix(awkward, {"a": 3.0, "b": 1.0}, total=4000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) <= {"a", "b"} and abs(n["a"] / 3000 - 1) < 0.2 and abs(n["b"] / 1000 - 1) < 0.2
    assert got.columns[: len(awkward.columns)] == awkward.columns
    assert rows(got, "doc_id", "copy") == rows(mixing.mix(awkward, {"a": 3.0, "b": 1.0}, total=4000), "doc_id", "copy")
    assert mixing.mix(empty).count() == 0


def test_mixing_by_brute_force(spark):
    """Copies by the inverse Poisson distribution of the hash, for null and repeated ids, null sources and sources without a weight."""
    given = [(i, f"t{i}", "ab"[i % 2]) for i in range(300)] + [(4, "other", "a"), (4, "other", "a"), (None, "text", "a"), (None, None, "a"), (400, "x", None), (401, "y", "c")]
    table = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(3)
    n = collections.Counter(s or "" for _, _, s in given)
    weight = {"a": 3.0, "b": 1.0, "": 1.0}
    want = collections.Counter()
    for i, t, s in given:
        rate = weight.get(s or "", 0.0) / sum(weight.values()) * 900 / n[s or ""]
        key = str(i) if i is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        copies, below = 0, math.exp(-rate)
        while rate and below <= u:
            copies += 1
            below += math.exp(copies * math.log(rate) - rate - math.lgamma(copies + 1))
        for c in range(1, copies + 1):
            want[i, t, s, c, copies] += 1
    got = mixing.mix(table, weight, total=900)
    assert collections.Counter(map(tuple, got.select("doc_id", "text", "source", "copy", "copies").collect())) == want
    assert {i for i, *_ in want} >= {4, None} and 401 not in {i for i, *_ in want}
    order = [r.shuffle_key for r in mixing.mix(table, weight, total=900).coalesce(1).collect()]
    assert len(set(order)) > 0.9 * len(order)


def test_lines(spark, awkward, empty):
    assert rows(lines.without_boilerplate(awkward), *awkward.columns) == rows(awkward, *awkward.columns)
    assert lines.without_boilerplate(empty).count() == 0
    text = "own line {0} of a certain length\n Cookie notice \nanother {0} line of text"
    table = spark.createDataFrame([(i, text.format(i), f"s{i}") for i in range(12)] + [(99, "Cookie notice", "s1"), (100, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.without_boilerplate(table).collect()}
    assert got[3] == (text.format(3).replace(" Cookie notice \n", ""), 1) and got[99] == ("Cookie notice", 0) and got[100] == (None, 0)
    assert lines.without_boilerplate(table, least=13).where("n_removed > 0").count() == 0
    menu = "Home News Contact Imprint Privacy Cookies Login Register Help Terms of use"
    table = spark.createDataFrame([(i, f"{menu}\nown {i}", f"s{i}") for i in range(30)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.text, r.n_removed) for r in lines.without_boilerplate(table).collect()} == {(i, f"own {i}", 1) for i in range(30)}


def _check_packing(spark, table, **options):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    got = [r.asDict() for r in packing.pack(table, queries.TOKENIZER, **options).collect()]
    whole = collections.Counter()
    for r in table.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        whole[r.doc_id, ids] += 1
    by_doc = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    found = collections.Counter()
    for (doc_id, tokens), pieces in by_doc.items():
        same = sum(n for (i, ids), n in whole.items() if i == doc_id and len(ids) == 4 * tokens)
        starts = collections.defaultdict(list)
        for p in pieces:
            starts[p["start"]].append(p)
        if same == 1:
            joined = b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"]))
            found[doc_id, joined] += 1
            assert sum(p["length"] for p in pieces) == tokens
        else:
            assert sum(p["length"] for p in pieces) == tokens * same
    assert all(found[k] == n for k, n in whole.items() if n == 1 and sum(m for (i, ids), m in whole.items() if i == k[0] and len(ids) == len(k[1])) == 1)
    ends = []
    for pieces in sequences.values():
        end = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        ends.append(end)
    assert max(ends) <= 2048 and sum(2048 - end for end in ends) < 2048


def test_packing(spark, docs, awkward, empty):
    _check_packing(spark, docs.coalesce(1))
    _check_packing(spark, awkward, window=3000)
    _check_packing(spark, docs.repartition(40), window=20_000)
    assert packing.pack(empty, queries.TOKENIZER).count() == 0


def test_word_encoder():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["it's DON'T 'tis we'll", "<|endoftext|> a<|startoftext|>b <| x", "ß ÀÉ İstanbul ıx ſt Œuvre ªº µ ²³ ½ a_b__c 1234 é1", " x y\x1cz \x85w", "Ως ΣΑΣ 日本語 مرحبا 한국어", "a\x00b \x7f", "", "x" * 5000, "ǅ ŉ Ⱥ ﬁ Å"]
    tokenizer, encoder = Tokenizer.from_file(queries.TOKENIZER), packing.encoder_of(queries.TOKENIZER)
    texts += ["Größe, ÆTHER & Łódź_1-2: 100% (x) [y] {z} `~^\\ ", " ", "\n.\n", "ÿŸſ"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    for given in ([None, *texts, None], texts[3:5], ["plain words"], []):
        assert encoder.encode_all(pa.array(["", *given], pa.string()).slice(1)) == [encoder.encode(t) for t in given]


def test_packing_digest(spark):
    full = {(r.doc_id, r.start, r.sequence_id): zlib.crc32(bytes(r.ids)) for r in packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), queries.TOKENIZER).collect()}
    assert {(r.doc_id, r.start, r.sequence_id): r.ids_crc32 for r in queries.op8_packing(spark, SF).collect()} == full


def test_assign_balances_cost():
    pieces, left = packing.assign([900, 800, 700, 600, 500, 400, 196], [2048, 2048])
    assert not left and sum(p[2] for p in pieces) == 4096
    assert packing.assign([5, 3], []) == ([], [(0, 0, 5), (1, 0, 3)])


def test_assign_by_brute_force():
    """The sequence of least cost with room, else the roomiest, for every piece in descending order."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = [int(x) for x in rng.integers(1, 100, rng.integers(1, 40))] + [100] * int(rng.integers(0, 5))
        many = sum(lengths) // 100
        room, cost, want, left = [100] * many, [0.0] * many, [], []
        for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
            start, size = 0, lengths[d]
            while size:
                fits = [k for k in range(many) if room[k] >= size]
                at = min(fits, key=lambda k: (cost[k], k)) if fits else max(range(many), key=lambda k: (room[k], -k), default=None)
                if at is None or not room[at]:
                    left.append((d, start, size))
                    break
                take = min(size, room[at])
                want.append((d, start, take, at, 100 - room[at]))
                room[at], cost[at] = room[at] - take, cost[at] + take + take * take / 2048
                start, size = start + take, size - take
        assert packing.assign(lengths, [100] * many) == (want, left)


def test_packing_tails_in_rounds(spark, docs, monkeypatch):
    """Tails that are too many for one task are packed by several, and theirs by one."""
    monkeypatch.setattr(packing, "TAIL_TOKENS", 6000)
    _check_packing(spark, docs.repartition(24))


def test_passages(spark, docs, awkward, empty):
    got = {r.doc_id: r for r in passages.without_repeats(awkward.where("doc_id IS NOT NULL")).collect()}
    assert got[8].text.count("Copied sentence") == 0 and got[8].n_removed == 8 and "And another end" in got[8].text and "Quite another" in got[8].text
    assert got[7].n_removed == 0 and got[5].text == o.LONG and got[6].text.strip() != o.LONG
    source = {r.doc_id: r.text for r in awkward.collect()}
    for r in got.values():
        if r.text is not None:
            rest, at = "", 0
            for s in r.spans:
                rest, at = rest + source[r.doc_id][at : s.start], s.end
            assert rest + source[r.doc_id][at:] == r.text
    assert passages.without_repeats(empty).count() == 0
    assert passages.without_repeats(awkward).count() == awkward.count()


def test_passages_by_brute_force(spark, docs):
    """Against sentences, spans and windows that are taken word by word in plain Python, on the table and on made texts."""
    rng = np.random.default_rng(8)
    made = []
    passage = [" ".join(f"p{k}w{i}" + ("." if rng.random() < 0.1 else "") for i in range(70)) for k in range(4)]
    for i in range(40):
        text = " ".join(f"v{x}" + (rng.choice([".", "!", '."', "\n", ""], p=[0.1, 0.02, 0.02, 0.06, 0.8])) for x in rng.integers(0, 500, int(rng.integers(0, 160))))
        made.append((i, text + (" Junk junk" * 40 if i % 9 == 0 else "") + "\n" + (passage[i % 4].upper() if i % 3 else "") + (" " + passage[(i + 1) % 4] if i % 5 == 0 else "")))
    for given in (made, [(r.doc_id, r.text) for r in docs.collect()]):
        table = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        assert {r.doc_id: (r.text, r.n_removed) for r in passages.without_repeats(table).collect()} == o.without_passages(given)
    assert sum(n > 0 for _, n in o.without_passages(made).values()) > 20


def _spans_within(words, a, b):
    """Runs of words that the spans of a text take from its words a to b."""
    return {tuple(words[i:j]) for i, j in o.passage_spans(" ".join(words))[0] if i >= a and j <= b}


def test_any_shared_run_of_50_words_holds_a_common_span(spark):
    rng = np.random.default_rng(4)
    made = lambda n, ends: [f"w{x}" + ("." if e else "") for x, e in zip(rng.integers(0, 1000, n), rng.random(n) < ends, strict=True)]
    for k in range(200):
        run = made(50, [0, 0.02, 0.05, 0.1, 0.3][k % 5])
        around = [(made(a, 0.05), made(b, 0.05)) for a, b in rng.integers(0, 60, (2, 2))]
        one, two = (_spans_within(before + run + after, len(before), len(before) + 50) for before, after in around)
        assert one & two
    sentence = lambda n, name: " ".join(f"{name}{i}" for i in range(n - 1)) + f" {name}."
    for a, b in ((26, 26), (30, 30), (35, 35), (26, 39)):
        passage = sentence(a, "p") + " " + sentence(b, "q")
        table = spark.createDataFrame([(1, "Full stop. " + passage + " first end"), (2, " ".join(f"x{i}" for i in range(20)) + " " + passage + " other stop")], "doc_id long, text string")
        got = {r.doc_id: r for r in passages.without_repeats(table).collect()}
        assert got[1].n_removed == 0 and got[2].n_removed > 0 and got[2].text.startswith("x0 ") and got[2].text.endswith("other stop")
        assert len(got[2].text.split()) <= 22 + a + b - 32


def test_short_shared_lines_stay(spark):
    """A menu, a notice and a sentence or two that documents share are no passage."""
    notice = "Home News Contact Imprint.\nWe use cookies to make this site work for you. Learn more.\nReleased under the MIT License."
    table = spark.createDataFrame([(i, f"{notice}\nOwn text of number {i} with words{i} of its own{i}.") for i in range(5)], "doc_id long, text string")
    assert passages.without_repeats(table).where("n_removed > 0").count() == 0


def test_rule_counts(spark, docs, awkward, empty):
    forest = trees.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for table in (docs, awkward):
        got = trees.judged(table, forest)
        want = []
        for r in table.collect():
            c = o.rule_counts(r.text)
            want.append((r.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
        assert rows(got, "doc_id", *stats.COUNTS, "base_failed") == sorted(want, key=repr)
        assert got.where("base_failed AND kept").count() == 0
    assert trees.judged(empty, None).count() == 0 and trees.judged(awkward, None).where("kept = base_failed").count() == 0


def _walk(forest, x):
    """Probability by going down each tree node by node."""
    total = forest.bias
    for node in forest.roots.tolist():
        while forest.left[node] != node:
            node = int(forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node])
        total += forest.value[node]
    return 1 / (1 + math.exp(-total))


def test_verdicts_by_brute_force(spark, docs, awkward):
    """The trees' probabilities and verdicts, one text and one node at a time."""
    import pyarrow as pa

    forest = trees.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for table in (docs, awkward, awkward.union(awkward)):
        want = []
        for r in table.collect():
            p = _walk(forest, stats.statistics(pa.array([r.text], pa.string()))[1][0])
            n, *_, repeated = o.rule_counts(r.text)
            want.append((r.doc_id, n >= 10 and 100 * repeated <= 20 * n and p >= trees.VERDICT, round(p, 9)))
        got = [(i, kept, round(p, 9)) for i, kept, p in rows(trees.judged(table, forest), "doc_id", "kept", "probability")]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_features_by_brute_force(docs, awkward):
    """What the models read of a text, counted in plain Python."""
    import pyarrow as pa

    for r in [*docs.collect(), *awkward.collect()]:
        x = dict(zip(stats.FEATURES, stats.statistics(pa.array([r.text], pa.string()))[1][0].tolist(), strict=True))
        text, w = r.text or "", o.words(r.text)
        n, chars, symbols, dup, repeated = o.rule_counts(r.text)
        lines_ = [line for line in text.split("\n") if o.words(line)]
        letters = [c for b in text.encode() for c in [b] if 65 <= c <= 90 or 97 <= c <= 122 or c >= 192]
        want = {
            "log_words": math.log1p(n), "word_length": chars / max(n, 1), "symbol_share": symbols / max(len(text), 1), "upper_share": sum(65 <= c <= 90 for c in letters) / max(len(letters), 1),
            "punctuation_share": sum(c in string.punctuation for c in text) / max(len(text), 1), "digit_share": sum(c in "0123456789" for c in text) / max(len(text), 1), "repeat_share": repeated / max(n, 1),
            "dup_line_share": dup / max(len(lines_), 1), "known_word_share": (n - len(set(w))) / max(n, 1), "doubled_share": sum(a == b for a, b in zip(w, w[1:])) / max(n, 1),
            "short_word_share": sum(len(y) <= 1 for y in w) / max(n, 1), "long_word_share": sum(len(y) > 12 for y in w) / max(n, 1), "sentence_ends": sum(y[-1] in ".!?" for y in w) / max(n, 1),
            "line_words": math.log1p(n / max(len(lines_), 1)), "exclamation_share": text.count("!") / max(len(text), 1),
        }
        assert all(abs(x[k] - want[k]) < 1e-9 for k in want) and want.keys() == x.keys()


def test_forest_is_monotonic_and_flat():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    label = (x[:, 0] + 0.3 * rng.random(4000) + 0.4 * np.sin(9 * x[:, 1]) < 0.8).astype(int)
    forest = trees.grow(x, label, np.array([-1, 0, 0]))
    grid = np.linspace(0, 1, 200)
    for b in (0.1, 0.5, 0.9):
        line = forest.margin(np.stack([grid, np.full(200, b), np.full(200, 0.5)], axis=1))
        assert (np.diff(line) <= 1e-9).all()
    assert ((forest.probability(x) > 0.5) == label).mean() > 0.9
    assert trees.grow(x, np.ones(4000, int), np.zeros(3)) is None


def test_ranking_by_brute_force(spark, docs, awkward):
    """Scores one text at a time; and the weights are where the ridged logistic loss of all drawn pairs has no slope."""
    import pyarrow as pa

    x, label = stats.training_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model = pairwise.fit(x, label)
    for table in (docs, awkward, awkward.union(awkward)):
        want = []
        for r in table.collect():
            z = [min(4.0, max(-4.0, (v - c) / s)) for v, c, s in zip(stats.statistics(pa.array([r.text], pa.string()))[1][0].tolist(), model.center, model.scale, strict=True)]
            strength = sum(a * w for a, w in zip([*z, *(v * v for v in z)], model.weights, strict=True))
            score = 1 / (1 + math.exp(-((strength - model.cut) * model.slope + math.log(0.3 / 0.7)))) if o.words(r.text) else 0.0
            want.append((r.doc_id, o.held_out(r.doc_id), round(score, 9)))
        got = [(i, h, round(s, 9)) for i, h, s in rows(pairwise.scores(table, model), "doc_id", "held_out", "score")]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng, size = np.random.default_rng(7), min(pairwise.PAIRS, 20 * len(x))
    pairs = list(zip(rng.choice(good, size).tolist(), rng.choice(bad, size).tolist(), strict=True))
    z = model.inputs(x)
    slope = np.zeros(z.shape[1])
    for i, j in pairs:
        d = z[i] - z[j]
        slope += d / (1 + math.exp(min(30.0, max(-30.0, float(d @ model.weights)))))
    assert np.abs(slope / size - 1e-3 * model.weights).max() < 1e-5


def test_pairwise_quality(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_pairwise_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == o.held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    model = pairwise.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert pairwise.scores(awkward, model).where("doc_id IN (2, 3, 4) AND score <> 0").count() == 0
    assert pairwise.scores(empty, model).count() == 0
    assert pairwise.learn(awkward, spark.createDataFrame([(1, 1), (5, None)], "doc_id long, quality int")) is None
    assert pairwise.accepted(awkward, model).columns == awkward.columns
