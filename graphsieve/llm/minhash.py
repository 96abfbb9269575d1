"""Near-duplicate groups by SuperMinHash signatures.

A text's set holds its distinct shingles of `width` words (A-Z lower-cased, split by white space). A SuperMinHash
signature gives each shingle a random permutation of the places 0..m-1 and keeps at place p the least rank, with a random
fraction, that any shingle has p at; as soon as every place holds a rank below the present one, no later rank can
change it, so long texts stop after a few ranks. Texts that agree in all places of a band meet in a bucket.

Texts with the same set are one class. Class representatives in a bucket are compared with the bucket's least doc_id;
links are confirmed on the full sets and joined by union-find. In a bucket whose members then still lie in several groups,
finer signatures of all members of other groups are held against each other, block by block, and those pairs that agree in
enough of PLACES places are confirmed on the full sets as well: the likeliest few first, then all that still lie apart. So a group of copies costs about one comparison a member,
and no pair in a bucket is left out unless its signatures say that it is far below the threshold. With the default 36
bands of 5 a pair of similarity 0.8 shares a bucket with a probability of 1 - 6e-7; the share of equal places has a standard deviation of
SPREAD, and what is enough lies `deviations` of them below the threshold. With 3.5 a pair at the very threshold of which neither member was joined
to the other's group by anyone else is left out with a probability of 2e-4; with 5 it is 3e-7, at the price of more pairs to confirm.

A bucket of n members, m of them outside its largest group, makes n * m / BLOCK rows twice, of about 800 bytes each, and n * m comparisons of
PLACES bytes in tasks of BLOCK * BLOCK at most; where m is 0, as in a group of copies, it makes none.

Defined cases: texts without words, and null texts, have the empty set, n_shingles 0, and are linked with nothing; a very long text is read whole, by itself, and its set is
compared in one task; a similarity of just percent / 100 is a link; a
text of fewer than `width` words has its word sequence as its one shingle; a null doc_id is linked with nothing, its
component_id is null and it is kept; rows that repeat a doc_id count as one document whose set may be any of theirs for links, and each
row returns its own n_shingles; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsieve.llm import textblocks as tb
from graphsieve.llm.groups import components
from graphsieve.llm.store import Scratch, small_batches, written

BANDS, ROWS = 36, 5
#: Places of the finer signature, and members of a bucket that are compared at once.
PLACES, BLOCK = 512, 1024
#: Standard deviation of the share of equal places at 0.8, for texts of up to SHORT shingles and for longer ones.
SHORT, SPREAD_SHORT, SPREAD_LONG, DEVIATIONS = 500, 0.0132, 0.0177, 3.5
#: Pairs that a member is first confirmed with in each block; only what these leave apart is held against all likely ones.
BEST = 4

PERMUTATION_BYTES = 24 << 20
_FRACTION = np.uint64(48)
_LOW48 = np.uint64((1 << 48) - 1)


def superminhash(values: np.ndarray, first: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """Signatures, one line of m numbers for each row; values: distinct element hashes, first: each row's first one.

    A row without elements keeps the greatest number at every place. Rows are taken together only so far as their elements'
    permutations fit in PERMUTATION_BYTES; a row of many elements is done before it needs any.
    """
    most = PERMUTATION_BYTES // (m * 2)
    parts, a = [], 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, "right")) - 1)
        parts.append(_signatures(values[first[a] : first[b]], first[a : b + 1] - first[a], m, seed))
        a = b
    return np.concatenate(parts) if parts else np.zeros((0, m), np.uint64)


def _signatures(values: np.ndarray, first: np.ndarray, m: int, seed: int) -> np.ndarray:
    rows = len(first) - 1
    out = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    kind = np.uint8 if m <= 256 else np.uint16 if m <= 65536 else np.uint32
    row = np.repeat(np.arange(rows), np.diff(first))
    value = tb.mix(values ^ np.uint64(seed * 2 + 1))
    places = None
    going = np.arange(len(value))
    for rank in range(m):
        draw = tb.mix(value + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = rank + ((draw >> _FRACTION) * np.uint64(m - rank) >> np.uint64(16)).astype(np.int64)
        if places is None:
            place = swap
        else:
            place = places[going, swap].astype(np.int64)
            places[going, swap] = places[going, rank]
            places[going, rank] = place
        np.minimum.at(out, row * m + place, (draw & _LOW48) | (np.uint64(rank) << _FRACTION))
        lines = np.unique(row)
        open_ = lines[out.reshape(rows, m)[lines].max(axis=1) >= np.uint64(rank + 1) << _FRACTION]
        if not len(open_):
            break
        flag = np.zeros(rows, bool)
        flag[open_] = True
        stay = flag[row]
        if places is None:
            value, row, place = value[stay], row[stay], place[stay]
            places = np.tile(np.arange(m, dtype=kind), (len(value), 1))
            going = np.arange(len(value))
            places[going, place] = 0
            places[going, 0] = place
        elif not stay.all():
            value, row, going = value[stay], row[stay], going[stay]
    return out.reshape(rows, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of a signature, other for other bands."""
    seeds = tb.mix(np.arange(1, bands + 1, dtype=np.uint64))
    out = np.tile(seeds, (len(signatures), 1))
    for j in range(rows):
        out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, j::rows][:, :bands])
    return out


def sets_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    texts = tb.texts_of(column)
    words = tb.words_of(texts)
    return tb.distinct(*tb.shingles_of(tb.hash_words(texts.data, words, lower=True), words, width))


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                values, first = sets_of(block.column("text"), width)
                size = np.diff(first)
                signatures = superminhash(values, first, bands * rows)
                hashes = band_hashes(signatures, bands, rows).view(np.int64)
                spread = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([tb.mix(values), tb.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1), axis=0, dtype=np.uint64)])
                keys = (spread[first[1:]] - spread[first[:-1]]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(size) + 1) * bands, bands), pa.int32()), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(size), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists], ["doc_id", "n_shingles", "key1", "key2", "bands"])

    return run


def _places(width: int, bands: int, rows: int):
    """Of each text its bands, and one byte for each place of a finer signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                values, first = sets_of(block.column("text"), width)
                hashes = band_hashes(superminhash(values, first, bands * rows), bands, rows)
                fine = (tb.mix(superminhash(values, first, PLACES)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(first)), pa.array([x.tobytes() for x in hashes], pa.binary()), pa.array([x.tobytes() for x in fine], pa.binary())], ["doc_id", "size", "bands", "places"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch, "text_b"):
                keep = []
                known, mine = None, None
                a, b = block.column("text_a"), block.column("text_b")
                leaders = block.column("a").to_pylist()
                values, first = sets_of(b, width)
                for i in range(block.num_rows):
                    if leaders[i] != known:
                        known, mine = leaders[i], sets_of(a.slice(i, 1), width)[0]
                    other = values[first[i] : first[i + 1]]
                    both = np.sort(np.concatenate([mine, other]))
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(shared > 0 and 100 * shared >= percent * (len(mine) + len(other) - shared))
                out = block.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, held: Scratch) -> DataFrame:
    """Those pairs (a, b) of doc_id whose sets have a Jaccard similarity of percent / 100 or more."""
    wanted = held.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    text = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return (
        pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirm(width, percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id long, text string)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = written(docs.mapInArrow(_sketches(width, bands, rows), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"), "sketches")
    with Scratch(spark) as held:
        labels = _labels(docs, sizes, width, percent, bands, rows, deviations, held)
    return (
        sizes.select("doc_id", "n_shingles")
        .join(labels.select(F.col("v").alias("doc_id"), "root"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _labels(docs: DataFrame, sketch: DataFrame, width: int, percent: int, bands: int, rows: int, deviations: float, held: Scratch) -> DataFrame:
    """(v, root) for every document that is linked with another."""
    known = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")

    # Sums are stored before they are joined, so that Spark can split the partitions of hot keys in the join.
    least = held.written(known.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "least")
    classes = held.written(known.select("doc_id", "key1", "key2").join(least, ["key1", "key2"]).select("doc_id", "rep"), "classes")
    reps = known.join(classes.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")

    entries = reps.select("doc_id", F.explode("bands").alias("bucket"))
    met = held.written(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last"), "met")
    buckets = held.written(entries.join(met, "bucket").select("bucket", "doc_id", "leader", "n"), "buckets")

    pairs = held.written(buckets.where("doc_id > leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    same = classes.where("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = held.written(confirmed(pairs, docs, width, percent, held).union(same), "edges")
    labels = components(edges)

    for best in (BEST, None):
        open_ = held.written(_open_buckets(buckets.where("n > 2").select("bucket", "doc_id"), labels, held), "open")
        inside = held.written(open_.select("doc_id").distinct(), "inside")
        places = docs.join(inside, "doc_id", "left_semi").mapInArrow(_places(width, bands, rows), "doc_id long, size long, bands binary, places binary")
        likely = held.written(_likely_pairs(open_, places, bands, percent, deviations, best), "likely")
        if not likely.isEmpty():
            edges = held.written(edges.union(confirmed(likely, docs, width, percent, held)), "edges")
            labels = components(edges)
    return labels


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns as they were, that come first in their group, by doc_id and text.

    Rows that repeat a doc_id are compared by their own texts, each as a document of its own: one goes only if its text is linked
    with one that stays, or if it repeats both doc_id and text.
    """
    several = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        found = near_duplicates(docs, width, percent, bands, rows)
        return docs.join(written(found.where("NOT kept").select("doc_id").distinct(), "gone"), "doc_id", "left_anti").select(docs.columns)
    # Numbers in the order of doc_id and text, stored as another run could give others; the number of ranges is fixed, as merged ones could lose the order.
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id IS NULL"))
    ranges = once.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    numbered = written(ranges.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text"), width, percent, bands, rows)
    return numbered.join(written(found.where("NOT kept").select(F.col("doc_id").alias("_row")), "gone"), "_row", "left_anti").select(docs.columns)


def _open_buckets(entries: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries (bucket, doc_id, root) of the buckets that lie in several groups, with the bucket's largest group as `main` and its
    number of members, n, and of members outside that group, minor."""
    held = scratch.written(entries.join(labels.select(F.col("v").alias("doc_id"), "root"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root")), "held")
    sizes = held.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("largest"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return held.join(scratch.written(several.select("bucket", F.col("largest.root").alias("main"), "n", (F.col("n") - F.col("largest.size")).alias("minor")), "several"), "bucket")


def _likely_pairs(open_: DataFrame, places: DataFrame, bands: int, percent: int, deviations: float, best: int | None) -> DataFrame:
    """Pairs (a, b) from other groups of a bucket whose signatures agree in enough places; with `best`, only so many of the likeliest for each member of a block.

    Members outside a bucket's largest group are held against all its members, block against block of about BLOCK members,
    so that no task gets a whole large bucket and no pair becomes a row unless it is likely.
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1))
    rows = open_.join(places, "doc_id").withColumn("j", F.pmod(F.xxhash64("doc_id"), blocks("n"))).withColumn("k", F.pmod(F.xxhash64("doc_id", F.lit(1)), blocks("minor")))
    column = ["bucket", "k", "j", "doc_id", "root", "size", "bands", "places", "probe"]
    held = rows.withColumn("k", F.explode(F.sequence(F.lit(0), blocks("minor") - 1))).withColumn("probe", F.lit(False))
    probes = rows.where("root <> main").withColumn("j", F.explode(F.sequence(F.lit(0), blocks("n") - 1))).withColumn("probe", F.lit(True))
    return held.select(column).union(probes.select(column)).groupBy("bucket", "k", "j").applyInArrow(_compare(bands, percent, deviations, best), "a long, b long").distinct()


def _compare(bands: int, percent: int, deviations: float, best: int | None):
    short, long_ = (PLACES * (percent / 100 - deviations * x) for x in (SPREAD_SHORT, SPREAD_LONG))

    def run(table: pa.Table) -> pa.Table:
        ids, roots, size = (table.column(c).to_numpy() for c in ("doc_id", "root", "size"))
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        bucket = np.array(table.column("bucket")[0].as_py(), np.int64).view(np.uint64)
        places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint8).reshape(-1, PLACES)
        own = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.uint64).reshape(-1, bands)
        earlier = own[:, : int(np.argmax(own[0] == bucket))]  # a pair counts in the first bucket that it shares
        x, y = np.flatnonzero(probe), np.flatnonzero(~probe)
        found = [np.zeros((0, 2), np.int64)]
        for i in x.tolist():
            other = y[roots[y] != roots[i]]
            other = other[~(earlier[other] == earlier[i]).any(axis=1)]
            equal = (places[other] == places[i]).sum(axis=1)
            near = np.flatnonzero(equal >= np.where(np.minimum(size[other], size[i]) <= SHORT, short, long_))
            if best and len(near) > best:
                near = near[np.argsort(-equal[near], kind="stable")[:best]]
            near = other[near]
            found.append(np.stack([np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


#: The groups by comparing all documents that share a shingle, for tables on which that can be afforded.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * k >= 80 * (n + m - k)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least ON least.doc_id = s.doc_id
"""
