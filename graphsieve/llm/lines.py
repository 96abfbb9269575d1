"""Removal of boilerplate lines by the number of distinct sites they stand on, with DataFrame functions only.

A HyperLogLog sketch of sites is kept for each line hash and merged by aggregation. Lines whose estimate is clearly
under or over the threshold are decided by it; those within `margin` of it get an exact distinct count. Lines on `least` sites
or more are removed wherever they stand, whatever their share of a text. Only a text that has nothing else is left as it is, so that
it does not become empty.

Lines are split at line feeds and compared without spaces around them; empty ones are never removed.

Defined cases: a null text stays null; an empty text, and one without boilerplate, stays as it is; a very long text is one row like any
other, of which only line hashes are shuffled before it is cut; a line on exactly `least` sites goes; a null source is no site; repeated
rows are treated alike, whatever their doc_id, as all goes by text and source; columns of any other name are kept; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsieve.llm.store import written

LEAST_SITES, MARGIN, LOG_REGISTERS = 10, 0.15, 12


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "").select(*[F.col(c) for c in docs.select(*columns).columns], _key(F.col("line")).alias("h"))


def boilerplate(docs: DataFrame, site: str = "source", least: int = LEAST_SITES, margin: float = MARGIN) -> DataFrame:
    """(h): hashes of the lines of docs that stand on `least` sites or more."""
    placed = _lines(docs, F.col(site).cast("string").alias("site"))
    spread = placed.where("site IS NOT NULL").groupBy("h").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    estimated = written(spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least * (1 - margin)), "spread")
    near = estimated.where(F.col("sites") <= least * (1 + margin)).select("h")
    exact = placed.join(near, "h", "left_semi").where("site IS NOT NULL").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= least)
    return written(estimated.where(F.col("sites") > least * (1 + margin)).select("h").union(exact.select("h")), "boilerplate")


def without_boilerplate(docs: DataFrame, site: str = "source", least: int = LEAST_SITES, margin: float = MARGIN) -> DataFrame:
    """docs with `text` cut; after their own columns n_lines, and n_removed lines. A column of docs with such a name is kept instead."""
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"c{i}") for i, c in enumerate(own)])
    flagged = boilerplate(docs, site, least, margin)
    whole = F.xxhash64("text").alias("t")
    # Stored before it is joined, and merged whatever its size, so that Spark can split the partitions of large groups of copies in the join.
    marks = written(_lines(docs.select(F.col("text").cast("string").alias("text")), whole).join(flagged, "h").groupBy("t").agg(F.collect_set("h").alias("bad")), "marks")
    met = inner.withColumn("t", F.xxhash64(F.col("text").cast("string"))).join(marks.hint("merge"), "t", "left").withColumn("lines", F.split("text", "\n"))
    kept = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("bad", _key(x)))
    sized = met.withColumn("kept", F.when(F.col("bad").isNotNull(), kept))

    cut = sized.withColumn("cut", F.coalesce(F.exists("kept", lambda x: F.trim(x) != ""), F.lit(False)))
    cut = cut.withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long")).withColumn("n_removed", F.when(F.col("cut"), F.size("lines") - F.size("kept")).otherwise(0).cast("long"))
    text = F.when(F.col("cut"), F.array_join("kept", "\n")).otherwise(F.col("text"))
    names = [("text" if c == "text" else f"c{i}") for i, c in enumerate(own)]
    return cut.withColumn("text", text).select(*[F.col(n).alias(c) for n, c in zip(names, own, strict=True)], *[c for c in ("n_lines", "n_removed") if c not in own])


SQL = f"""
WITH lines AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
flagged AS (SELECT line FROM lines WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {LEAST_SITES}),
bad AS (SELECT coalesce(list(line), []) AS bad FROM flagged),
parts AS (SELECT d.*, string_split(text, chr(10)) AS every, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, trim(x))) AS kept FROM documents d, bad),
cut AS (SELECT *, coalesce(len(every) > len(kept) AND len(list_filter(kept, lambda x: trim(x) <> '')) > 0, false) AS cut FROM parts)
SELECT doc_id, lang, source, n_chars, CASE WHEN cut THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  CAST(len(every) AS BIGINT) AS n_lines, CAST(CASE WHEN cut THEN len(every) - len(kept) ELSE 0 END AS BIGINT) AS n_removed
FROM cut
"""
