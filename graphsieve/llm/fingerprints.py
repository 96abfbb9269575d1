"""Bottom-k fingerprints of texts, with DataFrame functions only.

A text's shingles are its runs of five words (lower-cased, split by white space), or its whole word sequence if that is
shorter. The fingerprint holds the k least 64-bit hashes of distinct shingles, in ascending order; as text each is 16
hexadecimal digits, shifted so that text order is number order. Fingerprints of parts merge into that of the whole: the k least
of both. They estimate resemblance, containment and the number of distinct shingles; with fewer than k shingles the estimates are exact.

Defined cases: a null text counts as an empty one; without words a fingerprint is empty, two empty ones have resemblance 1, and an
empty and another one 0. In `with_edits`, rows that repeat a doc_id are one place in the ring of documents, represented by
the least text; a null doc_id comes after the smallest, and its next document is the first; a single document is next to
itself; where no row has an id, the next text is empty; a very long text is one row, whose shingle hashes are held at once; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, K = 5, 128
#: Rows of a range of ids that one window takes, and the most ranges there are; beyond them ranges get longer.
RANGE_ROWS, MOST_RANGES = 8192, 1 << 17


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles, with repeats, in text order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        several = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(n >= width, several).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), runs)


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """array<bigint> of the k least distinct shingle hashes. In long texts, hashes that are all but certain not to be among them are set aside before sorting."""

    def sketch(h: Column) -> Column:
        bound = F.lit(-(2.0**63)) + F.lit(2.0**64 * 3 * k) / F.size(h)
        low = F.array_distinct(F.filter(h, lambda x: x < bound))
        return F.when(F.size(h) <= 4 * k, _least(h, k)).otherwise(_let(low, lambda x: F.when(F.size(x) >= k, F.slice(F.sort_array(x), 1, k)).otherwise(_least(h, k))))

    return _let(shingle_hashes(text, width), sketch)


def to_text(sketch: Column) -> Column:
    """Sign bit flipped, so that hexadecimal text sorts as the numbers do."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), "")


def from_text(text: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(0), (F.length(text) / 16).cast("int") - 1), lambda i: F.conv(F.substr(text, (i * 16 + 1).cast("int"), F.lit(16)), 16, 10).cast("decimal(20,0)"))
    return F.when(F.length(text) > 0, F.transform(digits, lambda x: (x - F.expr("CAST('9223372036854775808' AS DECIMAL(20, 0))")).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """struct of resemblance, the estimated Jaccard similarity of the shingle sets, and containment, the estimated share of a's shingles that b has.

    Two empty sets have resemblance and containment 1; an empty and another one have 0.
    """

    def of(u: Column) -> Column:
        share = F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
        held = F.least(F.lit(1.0), share * distinct_shingles(u, k) / F.greatest(distinct_shingles(a, k), F.lit(1.0)))
        both_empty = F.size(u) == 0
        return F.struct(F.when(both_empty, F.lit(1.0)).otherwise(share).alias("resemblance"), F.when(both_empty, F.lit(1.0)).otherwise(held).alias("containment"))

    return _let(merge(a, b, k), of)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    return likeness(a, b, k)["resemblance"]


def containment(a: Column, b: Column, k: int = K) -> Column:
    return likeness(a, b, k)["containment"]


def merged(parts: DataFrame, key: str, sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """(key, sketch): one fingerprint for each key out of many parts. A key's hashes are first cut to k within each of `salts` shares; one whose parts are all empty has an empty fingerprint."""
    rows = parts.select(key, F.explode(sketch).alias("h")).distinct().withColumn("salt", F.pmod(F.col("h"), F.lit(salts)))
    for by in ([key, "salt"], [key]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("place") <= k)
    full = rows.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    keys = parts.select(key).distinct()
    return keys.join(full, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce(sketch, F.array().cast("array<bigint>")).alias(sketch))


def _ranges(base: DataFrame, rows: int) -> tuple[Column, list[int | None], list[int]]:
    """The number of the range of ids that a row's id lies in; of each range its greatest id, None where it is empty, and the range that comes after it in the ring.

    The driver gets one quantile and one greatest id a range, MOST_RANGES numbers at most; a row finds its range by binary search.
    """
    ids = base.select("id").where("id IS NOT NULL")
    count = ids.count()
    wanted = min(MOST_RANGES, max(-(-count // rows), 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = ids.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)] or [1.0], min(1_000_000, max(10_000, 10 * wanted)))).first()[0] or []
    bounds = sorted(set(found))
    levels = max(1, len(bounds).bit_length())
    held = F.lit([*bounds, *[(1 << 63) - 1] * ((1 << levels) - 1 - len(bounds))]).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(levels))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(held, at + step - 1) < F.col("id"), step).otherwise(0))
    greatest = dict(ids.withColumn("part", part).groupBy("part").agg(F.max("id")).collect())
    full = sorted(greatest)
    above = dict(zip(full, [*full[1:], *full[:1]], strict=True))
    return part, [greatest.get(i) for i in range(1 << levels)], [above.get(i, 0) for i in range(1 << levels)]


def _dealt(base: DataFrame, rows: int) -> DataFrame:
    """base (id, body) with part and own: ranges of ids, and in each a copy (not own) of the document that comes next after its smallest id.

    Rows without an id are dealt to parts of their own by their text, each with a copy of the greatest document.
    """
    part, greatest, above = _ranges(base, rows)
    if not any(x is not None for x in greatest):
        return base.withColumn("part", F.pmod(F.xxhash64("body"), F.lit(64)).cast("int")).withColumn("own", F.lit(True))
    spread = min(len(greatest), 64)
    lost = [len(greatest) + i for i in range(spread)] if base.where("id IS NULL").limit(1).count() else []
    first = max(x for x in greatest if x is not None)

    def place(at: Column, own: bool) -> Column:
        return F.struct(at.cast("int").alias("part"), F.lit(own).alias("own"))

    numbered = base.withColumn("range", F.when(F.col("id").isNotNull(), part))
    copies = F.when(F.get(F.lit(greatest).cast("array<bigint>"), F.col("range")) == F.col("id"), F.array(place(F.get(F.lit(above), F.col("range")), False)))
    places = [F.when(F.col("id").isNull(), F.array(place(F.lit(len(greatest)) + F.pmod(F.xxhash64("body"), F.lit(spread)), True))), F.when(F.col("id").isNotNull(), F.array(place(F.col("range"), True))), copies]
    if lost:
        places.append(F.when(F.col("id") == first, F.array(*[place(F.lit(i), False) for i in lost])))
    none = F.array().cast("array<struct<part:int,own:boolean>>")
    return numbered.select("id", "body", F.explode(F.concat(*[F.coalesce(x, none) for x in places])).alias("place")).select("id", "body", "place.part", "place.own")


def with_edits(docs: DataFrame, k: int = K, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every row of docs and of its edited text, whose last half is taken from the next document's beginning.

    Texts are exchanged once, by ranges of ids, in which the next document is the row before; the plan has no join.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    dealt = _dealt(base, rows).repartition("part").withColumn("own_sketch", fingerprint(F.col("body"), k=k))
    by = Window.partitionBy("part").orderBy("own", "id", F.desc("body"))
    last_of_id = F.col("id").isNotNull() & ~(F.lead("id").over(by).eqNullSafe(F.col("id")) & F.lead("own").over(by).eqNullSafe(F.col("own")))
    marked = dealt.withColumn("shown", F.when(last_of_id, F.struct("body", "own_sketch")))
    follower = F.last("shown", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    met = marked.withColumn("next", follower).where("own")
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.coalesce("next.body", F.lit("")), F.lit(1), half))
    texts = met.select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "own_sketch", F.coalesce("next.own_sketch", F.array().cast("array<bigint>")).alias("next"))
    sketches = texts.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("own_sketch").alias("own"), fingerprint(F.col("edited"), k=k).alias("other"), "next")
    compared = sketches.select("*", likeness(F.col("own"), F.col("other"), k).alias("to_edited"), likeness(F.col("own"), F.col("next"), k).alias("to_next"))
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("own")).alias("fingerprint"), to_text(F.col("other")).alias("edited_fingerprint"),
        F.col("to_edited.resemblance").alias("near_edited"), F.col("to_next.resemblance").alias("near_next"),
        F.col("to_edited.containment").alias("contained_in_edited"), F.col("to_next.containment").alias("contained_in_next"), distinct_shingles(F.col("own"), k).alias("shingles"),
    )
