"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, all in DataFrame functions.

Each source gets a target from its weight.  Whole epochs come first: a target of
2.4 times the source takes every document twice, and only the remaining 0.4 is
sampled, by exponential keys -ln(u) / quality.  Keys are sorted within a source
and their sizes prefix-summed until the budget is met; the document on the edge
gives just the words still wanted, so the words taken meet the target to one word.

A source may hold any share of all rows: sorting and summing are dealt out by
(source, key bucket), with the buckets' totals summed first, so no task gets a
whole source.  Buckets are steps of the key's logarithm, so they hold small shares
(about 1 in 1000 at most) whatever the quality of a source is.  u comes from md5 of the seed and doc_id, so reruns agree.

Null or blank text has size 0 and gives nothing; null source is a source of its
own, last in order; rows that repeat a doc_id are rows like any other; an empty
table gives no rows; columns other than doc_id, text and source take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from orrery.llm.common import columns_of, staged, table

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 17
#: Key buckets from a key to its double.
BUCKETS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Signs that prose has few of; their share of a text lowers its quality.
SIGNS = r"[|%&$#*{}<>\\0-9]"


def quality() -> Column:
    """Between 0.1 and 1: how free of signs and digits the text is."""
    share = F.regexp_count("text", F.lit(SIGNS)) / F.greatest(F.length("text"), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 5.0 * share), F.lit(0.1))


def uniform(seed: int) -> Column:
    """In (0, 1], from the first 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(skey, source_size, target) of (skey, source, source_size): shares by weight, none above cap times its source.

    Capping and resharing until none is above has one end: target = min(cap * size,
    rate * weight).  Sources in order of cap * size / weight are capped first, so the
    rate follows from sums over that order; it falls once more than those are left
    out, so the largest rate that caps nothing further is the one.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn("most", cap * F.col("source_size"))
    every, before = W.partitionBy(), W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rate = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rated = weighed.withColumn("rate", rate).withColumn("rate", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("most"), F.col("rate"))).over(every))
    return rated.select("skey", "source_size", F.least("most", F.coalesce(F.col("rate") * F.col("weight"), F.col("most"))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs."""
    sized = columns_of(docs, "doc_id", "text", "source").select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"),  # null apart from ''
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(seed)) / quality()).alias("key"),
    )
    # a monotone map of the key, so that buckets keep its order; a key of 0 comes first
    sized = staged(sized.withColumn("bucket", F.when(F.col("key") > 0, F.floor(BUCKETS * F.log2("key"))).otherwise(-1 << 20).cast("int")))
    buckets = sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = buckets.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size"))
    before = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(targets(sources, weights, share, cap), "skey").select("skey", "bucket", "offset", "source_size", "target")
    within = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = sized.join(offsets, ["skey", "bucket"]).withColumn("ahead", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("ahead")))
    return ranked.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
           / coalesce(greatest(0.1, 1.0 - 5.0 * (len(regexp_extract_all(text, '[|%&$#*{}<>\\0-9]'))::DOUBLE / greatest(length(text), 1))), 0.1) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3.0 AS most,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
rates AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS rate
  FROM sources WINDOW b AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size,
         least(most, coalesce((SELECT max(rate) FROM rates WHERE rate * weight <= most) * weight, most)) AS target
  FROM rates),
ranked AS (
  SELECT s.*, g.source_size, g.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - ahead)))::BIGINT AS taken
FROM ranked
"""
