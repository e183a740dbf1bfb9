"""Exact top-k search by distributed histogram selection.

Vectors become integer vectors floor(scale * x). The stated queries meet all rows in blocks: every cell (block of rows,
chunk of queries) scores all its pairs with matrix products. Per query, a global histogram of the scores is refined round
by round: each round splits the interval that holds the kth value into `bins`, until the interval is one integer wide.
Then each cell gives the rows above the kth value and as many of the smallest ids at it as are still needed, and the
order (score descending, id ascending) breaks ties.

Blocks and chunks are packed once, one table row of some MB each, in the shared folder, and a cell is one of each. Scores
are recomputed in each round rather than kept: they are (queries x rows) numbers, the vectors are not. A cell reports at
most k values a query, as the global kth value can't be below its own kth one; so bins may be many and rounds few.

Defined cases: vectors that are null or empty or hold null or non-finite components, and null ids, take no part;
vectors of another length than the most frequent one (ties: the shorter) take no part; repeated rows are separate
candidates, but every row with the query's id is its own row; a repeated query row (same id and vector) asks once, and
rows of one id with different vectors ask each on their own, so that such an id has every rank once for each vector; with
fewer than k candidates all are returned; finite components of any size take part, and a score beyond 64 bits counts as
the largest or smallest 64-bit integer; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, stored, table

#: Scores are kept within this, so that intervals have room at both ends.
MOST = 2**63 - 2**10
#: Queries that one product takes at a time, with all rows of a block.
TILE = 256


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, v array<double> and the columns `more`: rows whose vector is complete, finite and of the usual length."""
    v = F.col("embedding").cast("array<double>")
    good = F.size("v") > 0
    x = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), *more)
    x = x.where(good & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = x.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return x.where(F.size("v") == usual["dim"]) if usual else x


def is_query(every: int):
    return F.pmod("vec_id", F.lit(every)) == 0


def _pack(t: pa.Table) -> pa.Table:
    """The rows of one group as one row: ids, keys and the vectors one after the other."""
    t = t.combine_chunks()
    flat = t.column("v").combine_chunks().flatten()
    return pa.table({"part": t.column("part").slice(0, 1), **{c: pa.array([t.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("ids", "keys")}, "m": pa.array([flat.to_numpy().astype("<f8").tobytes()], pa.binary())})


def packed(rows: DataFrame, n: int, name: str) -> DataFrame:
    """part, ids, keys, m: rows (ids, keys, v) dealt to n parts at random, so that repeated rows spread too."""
    dealt = rows.withColumn("part", F.floor(F.rand(20) * n).cast("int"))
    return stored(dealt.groupBy("part").applyInArrow(_pack, "part int, ids array<bigint>, keys array<bigint>, m binary"), name)


def laid_out(x: DataFrame, every: int, block_rows: int, chunk_rows: int, name: str) -> tuple[DataFrame, DataFrame, int, int] | None:
    """Blocks of rows and chunks of queries (both packed), and how many; None without queries. The numbers of rows hold for
    64 components. A query's key tells vectors of one id apart."""
    asked = x.where(is_query(every)).select("vec_id", "v").distinct()
    n, q, dim = x.agg(F.count("*"), F.count(F.when(is_query(every), 1)), F.max(F.size("v"))).first()
    if not q:
        return None
    blocks, chunks = (parts(rows * max(dim, 64), 64 * per) for rows, per in ((n, block_rows), (q, chunk_rows)))
    b = packed(x.select(F.col("vec_id").alias("ids"), F.lit(0).cast("bigint").alias("keys"), "v"), blocks, f"{name}-blocks")
    c = packed(asked.select(F.col("vec_id").alias("ids"), F.xxhash64("v").alias("keys"), "v"), chunks, f"{name}-chunks")
    return b, c, blocks, chunks


def in_cells(blocks: DataFrame, chunks: DataFrame, n: int, q: int, run, schema: str) -> DataFrame:
    """run(block, chunk) of every block with every chunk: both as tables of one row, of none where a part has no rows."""
    every_chunk, every_block = (F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in (q, n))
    left = blocks.withColumn("chunk", every_chunk).groupBy("part", "chunk")
    right = chunks.withColumnRenamed("part", "chunk").withColumn("part", every_block).groupBy("part", "chunk")
    return left.cogroup(right).applyInArrow(run, schema)


def read(t: pa.Table, *columns: str) -> list[np.ndarray]:
    """ids, keys and vectors of a packed part, and its lists of other columns."""
    if not t.num_rows:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), *[np.zeros(0, np.int64) for _ in columns]]
    ids, keys, *more = (np.asarray(t.column(c)[0].values, np.int64) for c in ("ids", "keys", *columns))
    return [ids, keys, np.frombuffer(t.column("m")[0].as_buffer(), "<f8").reshape(len(ids), -1), *more]


def as_table(schema: str, rows: list[list[np.ndarray]]) -> pa.Table:
    """Lists of columns, one below the other."""
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(np.concatenate([r[i] for r in rows]) if rows else [], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def tiles(n: int):
    for i in range(0, n, TILE):
        yield slice(i, min(n, i + TILE))


def integer_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as 64-bit integers, exact; beyond them the largest or smallest."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    with np.errstate(over="ignore"):
        most = np.sqrt((q**2).sum(1).max()) * np.sqrt((x**2).sum(1).max())
    if most < 2**24:  # every partial sum is exact in this type
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    # Huge components: whole numbers of any size, for the rows that have them.
    out = np.zeros((len(q), len(x)), np.int64)
    small_q, small_x = (np.abs(v).max(1) < 2**52 / v.shape[1] ** 0.5 / 2**26 for v in (q, x))
    out[np.ix_(small_q, small_x)] = (q[small_q] @ x[small_x].T).astype(np.int64)
    whole_q, whole_x = ([list(map(int, r)) for r in v.tolist()] for v in (q, x))
    for i, j in zip(*np.nonzero(~(small_q[:, None] & small_x[None, :])), strict=True):
        out[i, j] = max(-MOST, min(MOST, sum(a * b for a, b in zip(whole_q[i], whole_x[j], strict=True))))
    return out


def top_values(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the k greatest allowed values of each row of s."""
    low = np.iinfo(np.int64).min
    s = np.where(ok, s, low)
    if s.shape[1] > k:
        s = np.partition(s, s.shape[1] - k, 1)[:, -k:]
    i, j = np.nonzero(s != low)
    return i, s[i, j]


COUNTED = "query_id bigint, key bigint, at bigint, n bigint, above bigint"
PICKED = "query_id bigint, key bigint, vec_id bigint, score bigint"


def _counter(k: int, low: int, width: int, step: int):
    """Per query of a cell, the counts of the top bins of its interval, down to the cell's own kth value. width 0: the first
    interval, of all scores from `low` on."""

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        (ids, _, x), (of, keys, q, *more) = read(block), read(chunk, *(["lo", "above"] if width else []))
        lo, above = more if width else (np.full(len(of), low, np.int64), np.zeros(len(of), np.int64))
        out = []
        for t in tiles(len(of) if len(ids) else 0):
            s, base = integer_scores(q[t], x), lo[t].view(np.uint64)
            # Distance from the interval's lower end, which 64 bits without a sign always hold.
            ok = of[t][:, None] != ids[None, :]
            if width:
                ok &= (s >= lo[t][:, None]) & (s.view(np.uint64) - base[:, None] < np.uint64(width))
            i, v = top_values(s, ok, k)
            nth = (v.view(np.uint64) - base[i]) // np.uint64(step)
            pairs, n = np.unique(np.stack([i.astype(np.uint64), nth]), axis=1, return_counts=True) if len(i) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            j = pairs[0].astype(np.int64)
            out.append([of[t][j], keys[t][j], (base[j] + pairs[1] * np.uint64(step)).view(np.int64), n, above[t][j]])
        return as_table(COUNTED, out)

    return run


def _picker(k: int):
    """Per query of a cell, its rows above the kth value and the smallest ids at it."""

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        (ids, _, x), (of, keys, q, kth, above) = read(block), read(chunk, "lo", "above")
        order = np.argsort(ids, kind="stable")
        ids, x, out = ids[order], x[order], []
        for t in tiles(len(of) if len(ids) else 0):
            s = integer_scores(q[t], x)
            other, bar = of[t][:, None] != ids[None, :], kth[t][:, None]
            i, j = np.nonzero((s > bar) & other)
            ti, tj = np.nonzero((s == bar) & other)
            need = np.arange(len(ti)) - np.searchsorted(ti, ti, "left") < k - above[t][ti]
            i, j = np.concatenate([i, ti[need]]), np.concatenate([j, tj[need]])
            out.append([of[t][i], keys[t][i], ids[j], s[i, j]])
        return as_table(PICKED, out)

    return run


def with_interval(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """The chunks with lo and above of each of their queries, in their order."""
    at = chunks.select("part", F.posexplode(F.arrays_zip("ids", "keys")).alias("pos", "q")).select("part", "pos", "q.ids", "q.keys")
    got = at.join(state, (F.col("ids") == F.col("query_id")) & (F.col("keys") == F.col("key")), "left")
    # A query without candidates has no interval; any does.
    lists = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("above", F.lit(0)).alias("above"))))
    lists = got.groupBy("part").agg(lists.alias("s")).select("part", F.col("s.lo").alias("lo"), F.col("s.above").alias("above"))
    return chunks.join(lists, "part")


def whole_components(v, scale: float):
    """floor(scale * x) of every component, as doubles. One beyond 2^62 is a whole number already; one beyond the largest
    double stays there."""
    most = float(np.finfo(float).max)

    def one(c):
        y = F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))
        return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)

    return F.transform(v, one)


def histogram_topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, bins: int = 1 << 16, block_rows: int = 8192, chunk_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score (long) for each row whose id is divisible by `every`, against all rows."""
    x = stored(usable(vectors).withColumn("v", whole_components("v", scale)), "topk-vectors")
    laid = laid_out(x, every, block_rows, chunk_rows, "topk")
    if not laid:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    blocks, chunks, n, q = laid
    largest = min(float(MOST), 1.001 * x.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()[0])
    low, width, step, now = -int(largest) - 1, 0, 1, chunks  # by Cauchy-Schwarz no score is lower
    while step * bins < 2 * int(largest) + 3:
        step *= bins  # so that bins fill each interval exactly
    while step:
        got = in_cells(blocks, now, n, q, _counter(k, low, width, step), COUNTED)
        got = got.groupBy("query_id", "key", "at").agg(F.sum("n").alias("n"), F.max("above").alias("above"))
        got = got.withColumn("upto", F.col("above") + F.sum("n").over(W.partitionBy("query_id", "key").orderBy(F.desc("at"))))
        # The first bin with k scores at or above it; the lowest bin, if there are fewer than k candidates.
        last = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.col("upto") < k, F.when(F.col("upto") < k, F.col("at")), F.desc("at")))
        state = stored(got.withColumn("i", last).where("i = 1").select("query_id", "key", F.col("at").alias("lo"), (F.col("upto") - F.col("n")).alias("above")), "topk-kth")
        # query_id, key, lo: lowest score of the interval that holds the kth value; above: how many scores are above it
        now, width, step = with_interval(chunks, state), step, step // bins
    return ranked(in_cells(blocks, now, n, q, _picker(k), PICKED), k).select("query_id", "rank", "vec_id", "score")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_topk(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
