"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash of id and text and laid end to end, up to `max_repeats` times. A copy's virtual
finish time is the source's words up to and with it, divided by the source's target. All copies are range-sorted by
that time and the sorted list is cut where its words would exceed the budget.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
never taken (taken 0); repeated rows are separate documents; ties in time go to the smaller doc_id, then the earlier
copy; a very long text counts by its words and is taken whole or not at all, so a mix may miss its end by one document; no rows give no rows. Columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, parts, stored, table

KEY_BITS = 60


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """sid, source, source_size, target for each source; `sizes` has source, size. One row a source goes through the windows."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    by = W.orderBy("ratio", "sid")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("left_w", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
    whole = W.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("before")) / F.col("left_w"))
    s = s.withColumn("full", F.col("ratio") <= F.col("level"))
    s = s.withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("at"))
    return s.select("sid", "source", "source_size", target.alias("target"))


def weighted_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix", rows_per_bucket: int = 2_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken. Two sorts on narrow rows; the text is read once."""
    # The text counts too, so that rows of one id, or without one, spread.
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    order = F.conv(F.substring(F.md5(key.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), order.alias("h"))
    d = stored(d, "mix-sizes")
    n, budget = d.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = stored(source_targets(d, weights, max_repeats).coalesce(1), "mix-targets")
    # The number of buckets follows the rows, so a source of any share is spread.
    bits = max(0, parts(n, rows_per_bucket) - 1).bit_length()
    d = d.withColumn("bucket", F.shiftrightunsigned("h", KEY_BITS - bits) if bits else F.lit(0).cast("bigint"))
    cells = d.groupBy("source", "bucket").agg(F.sum("size").alias("cell")).withColumn(
        "base", F.coalesce(F.sum("cell").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "bucket", "base", "source_size", "target")
    inner = W.partitionBy("d.source", "d.bucket").orderBy("h", "doc_id", "size")
    v = d.alias("d").join(cells.alias("c"), F.expr("d.source <=> c.source AND d.bucket = c.bucket")).select(
        "doc_id", "d.source", "size", "source_size", "target", (F.col("base") + F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0))).alias("cum"))
    v = stored(v, "mix-times")

    def at(e):  # virtual finish time of copy e
        return (F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("target")

    bins = parts(n, rows_per_bucket) + 63
    alive = v.where("size > 0 AND target > 0")
    copies = alive.select("doc_id", "size", F.explode(F.array(*[F.struct(at(e).alias("t"), F.lit(e).alias("e")) for e in range(max_repeats)])).alias("c")).select(
        "doc_id", "size", "c.t", "c.e", F.least(F.floor(F.col("c.t") * bins), F.lit(2 * bins)).alias("bin"))
    upto = copies.groupBy("bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(W.orderBy("bin")))
    cut = upto.where(F.col("upto") > budget).orderBy("bin").first()
    if cut is None:
        taken = F.when(F.col("target") > 0, F.col("size") * max_repeats).otherwise(F.lit(0))
    else:
        run = F.sum("size").over(W.orderBy("t", "doc_id", "e").rowsBetween(W.unboundedPreceding, 0)) + F.lit(cut["upto"] - cut["words"])
        # The first copy over the budget; every copy sorted before it is in the mix.
        stop = copies.where(F.col("bin") == cut["bin"]).withColumn("run", run).where(F.col("run") > budget).orderBy("t", "doc_id", "e").first()
        last = (stop["t"], stop["doc_id"], stop["e"])
        before = [F.when((at(e) < last[0]) | ((at(e) == last[0]) & (F.col("doc_id") < last[1])) | ((at(e) == last[0]) & F.col("doc_id").eqNullSafe(last[1]) & F.lit(e < last[2])), F.col("size")).otherwise(F.lit(0)) for e in range(max_repeats)]
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(before[1:], before[0])).otherwise(F.lit(0))
    return v.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("bigint").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][1 + (sid - 1) % 3] AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM s1),
s3 AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
              CAST(sum(w) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w,
              CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s2),
s4 AS (SELECT *, CAST(budget - before AS DOUBLE) / left_w AS level FROM s3),
s5 AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS lv FROM s4),
s AS (SELECT source, source_size, budget, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE w * lv END AS target FROM s5),
v AS (SELECT doc_id, size, source_size, target, budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
             row_number() OVER () AS uid
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT uid, size, budget, sum(size) OVER (ORDER BY CAST(e * source_size + cum AS DOUBLE) / target, doc_id, e ROWS UNBOUNDED PRECEDING) AS run
      FROM v, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
k AS (SELECT uid, CAST(sum(size) AS BIGINT) AS taken FROM c WHERE run <= budget GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM v LEFT JOIN k USING (uid)
"""
