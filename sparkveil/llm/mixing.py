"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash. Per source, the mix takes the documents below a hash threshold once more than the others.
The threshold comes from sums by (source, hash bucket): the bucket where the running sum passes the budget is refined
by the next bits of the hash, and only that one. Nothing is sorted but the histograms.

Defined cases: a null text has size 0 (taken 0); null is a source of its own, weighed last; rows with equal hashes
(repeated ids) are taken alike within their source; rows without an id are told apart by their text; a document of size 0
is never taken; an empty table gives no rows; columns of the input whose names clash with those added stay as they are
in ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, materialize, words

#: Bits of a document's hash, and of a histogram level.
HASH_BITS, LEVEL_BITS = 52, 13
#: Parts into which the rows of a source are dealt when they meet its limit, and sources whose limits are broadcast at most.
SALTS, FEW_SOURCES = 64, 100_000


def doc_hash(key: Column, text: Column) -> Column:
    """The first 52 bits of MD5 of the id, or of the text if there is none; other SQL engines compute it alike."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): ``share`` of all sizes dealt by weight, no target above
    ``most`` times its source. The weights repeat along the sources by code point, null last.

    The level at which each source fills up is its cap over its weight; in that order, a source is capped while what is
    left for it, at the common level, exceeds its cap; after the first that is not, the levels fall, so the highest of
    those levels is the common one. The table has one row per source.
    """
    n = len(weights)
    by_name, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fill", F.col("source").asc_nulls_last())
    dealt = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    dealt = dealt.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    upto = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everyone = W.partitionBy()
    dealt = dealt.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    common = F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(everyone)
    return dealt.withColumn("common", common).select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("common"))).alias("target"))


def _boundary(rows: DataFrame, bucket: Column, budgets: DataFrame) -> DataFrame:
    """Per source the bucket in which the running sum passes the budget, with what is left for it. A budget that all
    buckets together don't pass has no boundary."""
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    running = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bucket")))
    joined = running.join(budgets, running["source"].eqNullSafe(budgets["s"]), "inner").where("upto > budget")
    return joined.groupBy("s", "budget").agg(F.min(F.struct("bucket", "upto", "n")).alias("b")).select("s", F.col("b.bucket").alias("bucket"), (F.col("budget") - F.col("b.upto") + F.col("b.n")).alias("budget"))


def _rows(docs: DataFrame, key: str, source: str, text: str, names: list[str]) -> DataFrame:
    """``docs`` with source, size and hash under these names."""
    t = F.col(text).cast("string")
    return docs.withColumns(dict(zip(names, (F.col(source), F.size(words(t)).cast("long"), doc_hash(F.col(key), t)), strict=True)))


def mix_limits(base: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, size, hash) -> per source t_source, source_size, target, whole (copies of every document) and below (the
    hash under which a document is taken once more)."""
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = materialize(targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))

    # The first two levels of the histogram, then the few hashes of the bucket that is left.
    shift1, shift2 = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS
    first = materialize(_boundary(base, F.shiftright("hash", shift1), targets.select(F.col("source").alias("s"), "budget")))
    inside = base.join(first, base["source"].eqNullSafe(first["s"]) & (F.shiftright("hash", shift1) == first["bucket"])).select("source", "size", "hash")
    second = materialize(_boundary(inside, F.shiftright("hash", shift2), first.select("s", "budget")))
    inside = base.join(second, base["source"].eqNullSafe(second["s"]) & (F.shiftright("hash", shift2) == second["bucket"])).select("source", "size", "hash")
    last = materialize(_boundary(inside, F.col("hash"), second.select("s", "budget")).withColumnRenamed("bucket", "at"))
    # The documents with the boundary hash go in if the sum then lies nearer to the budget than without them.
    at = last.join(base, base["source"].eqNullSafe(last["s"]) & (base["hash"] == last["at"])).groupBy("s", "at", "budget").agg(F.sum("size").alias("n"))
    limits = at.select("s", F.when(F.col("n") - F.col("budget") < F.col("budget"), F.col("at") + 1).otherwise(F.col("at")).alias("below"))
    return targets.join(limits, targets["source"].eqNullSafe(limits["s"]), "left").select(F.col("source").alias("t_source"), "source_size", "target", "whole", F.coalesce("below", F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))).alias("below"))


def _limited(rows: DataFrame, source: str, hash_: str, limits: DataFrame) -> DataFrame:
    """``rows`` beside their source's limits (the first column of ``limits`` is the source). Few limits are broadcast; else, as a source may hold a large part of all rows,
    its limit is copied to ``SALTS`` places, and its rows dealt among them."""
    limits = materialize(limits)
    mine = limits.columns[0]
    if limits.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(limits), rows[source].eqNullSafe(limits[mine]))
    [salt] = fresh(rows, "sv_salt")
    salted = limits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, rows[source].eqNullSafe(salted[mine]) & (F.pmod(rows[hash_], F.lit(SALTS)) == salted[salt]))


def mix_plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (size times the number of copies that the mix holds).
    ``options`` are those of ``mix_limits``."""
    plain = docs.select(F.col(key).alias("key"), F.col(source).alias("sv_source"), F.col(text).alias("sv_text"))
    base = materialize(_rows(plain, "key", "sv_source", "sv_text", ["source", "size", "hash"]).select("key", "source", "size", "hash"))
    mixed = _limited(base, "source", "hash", mix_limits(base, **options))
    copies = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    return mixed.select("key", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus: every row as often as the plan takes it, with the columns of ``docs``. The texts stay where they
    are: only sizes and hashes are summed."""
    names = fresh(docs, "sv_source", "sv_size", "sv_hash")
    rows = _rows(docs, key, source, text, names)
    base = materialize(rows.select(*[F.col(n).alias(c) for n, c in zip(names, ("source", "size", "hash"), strict=True)]))
    added = [*fresh(rows, "sv_l_source", "sv_l_size", "sv_l_target", "sv_l_whole", "sv_l_below"), *fresh(rows, "sv_copies")]
    limits = mix_limits(base, **options).toDF(*added[:5])
    joined = _limited(rows, names[0], names[2], limits)
    copies = F.when(F.col(names[1]) > 0, F.col(added[3]) + (F.col(names[2]) < F.col(added[4])).cast("long")).otherwise(0)
    each = F.explode(F.sequence(F.lit(1).cast("long"), copies))
    return joined.where(copies > 0).select(*[F.col(c) for c in docs.columns], each.alias(added[5])).drop(added[5])


ORACLE_OP4 = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM src),
f AS (
  SELECT *, cap / weight AS fill,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, weight * max(level) FILTER (fill >= level) OVER ()) AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (
  SELECT b.source, b.h, sum(b.size) AS n FROM base b GROUP BY b.source, b.h),
c AS (
  SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
d AS (
  SELECT c.source, c.h, c.n, c.upto, p.target - p.whole * p.source_size AS budget FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
edge AS (
  SELECT source, h AS at, n, n - upto + budget AS room
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS k FROM d WHERE upto > budget) WHERE k = 1),
lim AS (
  SELECT p.source, p.source_size, p.target, p.whole,
         CASE WHEN e.at IS NULL THEN CASE WHEN p.target - p.whole * p.source_size > 0 THEN 4503599627370496 ELSE 0 END
              WHEN e.n - e.room < e.room THEN e.at + 1 ELSE e.at END AS below
  FROM p LEFT JOIN edge e ON p.source IS NOT DISTINCT FROM e.source)
SELECT b.doc_id, b.size, l.source_size, l.target,
       (b.size * (l.whole + CASE WHEN b.h < l.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN lim l ON b.source IS NOT DISTINCT FROM l.source
"""
