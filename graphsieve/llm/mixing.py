"""Mixing sources to target weights by Poisson replication.

A source of n documents with target share p of m documents gets the mean repetition rate r = p * m / n. Each of its
documents is repeated as often as the inverse of the Poisson distribution with mean r says for a number from 0 to 1 that is
hashed out of seed and doc_id; expected counts are exact for any rate, and a run can be repeated. Copies are shuffled globally by a hash of
seed, doc_id and copy.

Defined cases: a null source counts as the empty one; a null doc_id draws by its text; rows that repeat a doc_id draw alike;
a source without a target weight gets none; null, empty and very long texts are repeated as they are; copies with equal keys, as of
repeated rows, come in any order; columns of docs that are named copy, copies or shuffle_key are kept instead of the operator's, and
of any other name as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsieve.llm.store import written

SEED = 17
TEMPERATURE = 0.5


def _uniform(*parts: Column) -> Column:
    """A multiple of 2^-52 from 0 to below 1, the leading bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None) -> DataFrame:
    """(site, rate): the mean repetition of each source. Without targets, shares go by the source's size to the power `temperature`."""
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "site string, weight double")
        weighed = counts.join(table, "site", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n") if total is None else F.lit(total)
    return weighed.join(F.broadcast(sums)).select("site", (F.col("weight") / F.col("all_weight") * wanted / F.col("n")).alias("rate"))


def distributions(rates: DataFrame) -> DataFrame:
    """(site, below): the cumulated Poisson probabilities of 0, 1, 2, ... up to where they are 1 but for rounding."""
    ways = rates.where("rate > 0").select("site", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int"))).alias("k"))
    upto = Window.partitionBy("site").orderBy("k")
    chance = F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.sum(F.ln(F.greatest("k", F.lit(1)))).over(upto))
    summed = ways.withColumn("chance", chance).withColumn("below", F.sum("chance").over(upto))
    return summed.groupBy("site").agg(F.sort_array(F.collect_list("below")).alias("below"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None, seed: int = SEED) -> DataFrame:
    """docs' rows repeated, in random order, with the columns copy (1, 2, ...), copies and shuffle_key after their own.

    The table of distributions, one row a source, is stored, so that Spark broadcasts it only if its size is small enough.
    """
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at = {c: F.col(f"c{i}") for i, c in enumerate(own)}
    key = F.coalesce(at["doc_id"].cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(at["text"], F.lit("")).cast("binary"))))
    table = written(distributions(rates(docs, targets, temperature, total)), "mixing")
    drawn = inner.withColumn("site", F.coalesce(at["source"].cast("string"), F.lit(""))).withColumn("key", key).withColumn("u", _uniform(F.lit(str(seed)), F.col("key")))
    counted = drawn.join(table, "site").withColumn("copies", F.size(F.filter("below", lambda b: b <= F.col("u"))).cast("long")).where("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("shuffle_key", F.xxhash64(F.lit(seed), "key", "copy"))
    mixed = copied.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return mixed.select(*[at[c].alias(c) for c in own], *[c for c in ("copy", "copies", "shuffle_key") if c not in own])


SQL = f"""
WITH counts AS (SELECT coalesce(source, '') AS site, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT site, pow(n, {TEMPERATURE}) / sum(pow(n, {TEMPERATURE})) OVER () * sum(n) OVER () / n AS rate FROM counts),
ways AS (SELECT site, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates),
chances AS (SELECT site, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1))) OVER (PARTITION BY site ORDER BY k)) AS chance FROM ways),
cumulated AS (SELECT site, k, sum(chance) OVER (PARTITION BY site ORDER BY k) AS below FROM chances),
drawn AS (
  SELECT d.*, coalesce(source, '') AS site,
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM cumulated c WHERE c.site = drawn.site AND c.below <= drawn.u) AS copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copies, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0
"""
