"""Hard negatives by product quantisation with stored residual norms.

Vectors become integer vectors floor(scale * x). They are cut into parts of `width` components; each part has a codebook
of 256 centres, fitted by k-means on a sample of at most `sample_rows` rows (the ones with the smallest hash). Every row
is stored with its codes and the norm of what the codes leave out. For an anchor, tables of inner products with all
centres give each row's approximate score by look-ups; by Cauchy-Schwarz the true score is within the anchor's norm times
the row's residual norm of it (plus the rounding of 32-bit sums). So in each cell (block of rows, chunk of anchors)
- positives: rows of the anchor's label whose upper bound reaches the kth greatest lower bound are scored exactly;
- negatives: for each window of scores, rows of other labels whose bounds meet the window and whose upper bound reaches
  the kth greatest lower bound among rows that are surely in it, are scored exactly.
Exact scores are integers; each cell gives at most k rows an anchor, or a window, and the cells' rows are merged by
(score descending, id ascending). Nothing depends on the codebooks but the number of rows scored exactly.

Defined cases: rows without id, label or vector, or with null or non-finite components, take no part; neither do vectors of
another length than the most frequent one (ties: the shorter). Every row with the anchor's id is its own row; repeated rows are
separate candidates, and a positive that is repeated has its negatives as often; a repeated anchor row (id, label and
vector) asks once, and anchors of one id with different vectors or labels ask each on their own. Components of any finite
size take part (beyond 2^40 without a bound, so always exactly); a score beyond 64 bits counts as the largest or smallest
64-bit integer. Fewer candidates than asked for give fewer rows, an anchor without positives none; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, stored, table
from .topk import in_cells, integer_scores, tiles, usable, whole_components

#: Components beyond this have no bound in 32-bit tables.
WIDE = 2.0**40
CENTRES = 256
#: Rows whose look-ups are summed at a time, so that the sums stay in the cache.
STRIP = 1024


class Codebooks:
    """Centres of each part, (parts, 256, width), with zeros beyond the last component."""

    def __init__(self, sample: np.ndarray, width: int, rounds: int, seed: int):
        sample = np.clip(sample, -WIDE, WIDE)
        self.dim, self.width = sample.shape[1], width
        cut = self.cut(sample)
        draw = np.random.default_rng(seed)
        self.centres = np.stack([self._fitted(cut[:, m], rounds, draw) for m in range(cut.shape[1])])

    def cut(self, x: np.ndarray) -> np.ndarray:
        n = -(-self.dim // self.width)
        return np.pad(x, ((0, 0), (0, n * self.width - self.dim))).reshape(len(x), n, self.width)

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, 1)

    @classmethod
    def _fitted(cls, x: np.ndarray, rounds: int, draw: np.random.Generator) -> np.ndarray:
        c = x[draw.choice(len(x), CENTRES, len(x) < CENTRES)].copy()
        for _ in range(rounds):
            at = cls.nearest(x, c)
            n = np.bincount(at, minlength=CENTRES)
            for j in range(x.shape[1]):
                c[n > 0, j] = np.bincount(at, x[:, j], CENTRES)[n > 0] / n[n > 0]
        return c

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (parts, rows) and residual norms; an infinite norm where a component is too large for a bound."""
        wide = np.abs(x).max(1, initial=0) > WIDE
        cut = self.cut(np.clip(x, -WIDE, WIDE))
        codes, left = np.empty((cut.shape[1], len(x)), np.uint8), np.zeros(len(x))
        for m in range(cut.shape[1]):
            codes[m] = self.nearest(cut[:, m], self.centres[m])
            left += ((cut[:, m] - self.centres[m][codes[m]]) ** 2).sum(1)
        return codes, np.where(wide, np.inf, np.sqrt(left) * (1 + 1e-9))

    def bounds(self, q: np.ndarray, codes: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, (queries, rows)."""
        wide = np.abs(q).max(1, initial=0) > WIDE
        q = np.clip(q, -WIDE, WIDE)
        tables = np.einsum("qmw,mcw->mcq", self.cut(q), self.centres).astype(np.float32)
        near = np.zeros((codes.shape[1], len(q)), np.float32)
        for at in range(0, len(near), STRIP):
            for m in range(len(tables)):
                near[at : at + STRIP] += tables[m][codes[m, at : at + STRIP]]
        # Every sum of at most `parts` rounded numbers, each no larger than the product of the norms.
        norm = np.sqrt((q**2).sum(1))
        largest = np.sqrt((self.centres**2).sum(2).max(1).sum())
        slack = norm * largest * (len(tables) + 2) * 2.0**-22 + 1e-3
        with np.errstate(invalid="ignore"):
            reach = np.where(np.isinf(residual)[None, :] | wide[:, None], np.inf, norm[:, None] * residual[None, :]) + slack[:, None]
        near = near.T.astype(np.float64)
        return near - reach, near + reach


def _pack(books: Codebooks | None):
    """The rows of one group as one row: ids, keys, labels, vectors one after the other, and for blocks codes and residual norms."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        codes, residual = books.encode(x) if books else (np.zeros(0, np.uint8), np.zeros(0))
        lists = {c: pa.array([t.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("ids", "keys", "labels")}
        binary = {"m": x.astype("<f8"), "codes": codes, "residual": residual.astype("<f8")}
        return pa.table({"part": t.column("part").slice(0, 1), **lists, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in binary.items()}})

    return run


def dealt(rows: DataFrame, n: int, books: Codebooks | None, name: str) -> DataFrame:
    """Rows (ids, keys, labels, v) packed into n parts, dealt at random, so that repeated rows spread too."""
    schema = "part int, ids array<bigint>, keys array<bigint>, labels array<bigint>, m binary, codes binary, residual binary"
    return stored(rows.withColumn("part", F.floor(F.rand(11) * n).cast("int")).groupBy("part").applyInArrow(_pack(books), schema), name)


class Part:
    """A packed part, read."""

    def __init__(self, t: pa.Table):
        self.ids, self.keys, self.labels = (np.asarray(t.column(c)[0].values, np.int64) for c in ("ids", "keys", "labels"))
        n = len(self.ids)
        self.x = np.frombuffer(t.column("m")[0].as_buffer(), "<f8").reshape(n, -1)
        self.residual = np.frombuffer(t.column("residual")[0].as_buffer(), "<f8")
        self.codes = np.frombuffer(t.column("codes")[0].as_buffer(), np.uint8).reshape(-1, len(self.residual) or 1)
        self.windows = t.column("windows")[0].as_py() if "windows" in t.column_names else None


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


HIT = "anchor_id bigint, key bigint, nth int, id bigint, score bigint"


def as_hits(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table({x.split()[0]: pa.array([r[i] for r in rows], kind) for i, (x, kind) in enumerate(zip(HIT.split(", "), kinds, strict=True))})


def _positives(books: Codebooks, k: int):
    """Of each anchor, the first k other rows of its label in this block."""

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and chunk.num_rows:
            b, c = Part(block), Part(chunk)
            rows_of = {label: np.flatnonzero(b.labels == label) for label in np.unique(c.labels).tolist()}
            for t in tiles(len(c.ids)):
                low, high = books.bounds(c.x[t], b.codes, b.residual)
                for i, (of, key, label) in enumerate(zip(c.ids[t].tolist(), c.keys[t].tolist(), c.labels[t].tolist(), strict=True)):
                    at = rows_of[label]
                    at = at[b.ids[at] != of]
                    at = at[high[i, at] >= kth(low[i, at], k)]
                    exact = integer_scores(c.x[t][i : i + 1], b.x[at])[0]
                    out += [(of, key, 0, int(b.ids[at[j]]), int(exact[j])) for j in first(exact, b.ids[at], k).tolist()]
        return as_hits(out)

    return run


def _negatives(books: Codebooks, k: int, least: int, most: int):
    """Of each window of an anchor, the first k rows of other labels in this block whose scores lie in it."""

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and chunk.num_rows:
            b, c = Part(block), Part(chunk)
            for t in tiles(len(c.ids)):
                low, high = books.bounds(c.x[t], b.codes, b.residual)
                for i, (of, key, label, of_positives) in enumerate(zip(c.ids[t].tolist(), c.keys[t].tolist(), c.labels[t].tolist(), c.windows[t], strict=True)):
                    windows = [(w["nth"], -(-least * w["score"] // 100), most * w["score"] // 100) for w in of_positives]
                    other, want = (b.labels != label) & (b.ids != of), np.zeros(len(b.ids), bool)
                    for _, lo, hi in windows:
                        meets = other & (high[i] >= lo) & (low[i] <= hi)
                        sure = meets & (low[i] >= lo) & (high[i] <= hi)
                        want |= meets & (high[i] >= kth(low[i, sure], k))
                    at = np.flatnonzero(want)
                    exact = integer_scores(c.x[t][i : i + 1], b.x[at])[0]
                    for nth, lo, hi in windows:
                        inside = np.flatnonzero((exact >= lo) & (exact <= hi))
                        out += [(of, key, nth, int(b.ids[at[j]]), int(exact[j])) for j in inside[first(exact[inside], b.ids[at[inside]], k)].tolist()]
        return as_hits(out)

    return run


def merged(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k of each group of cells' rows, with their rank."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def with_windows(chunks: DataFrame, positives: DataFrame) -> DataFrame:
    """The chunks with the positives' ranks and scores of each of their anchors, in their order."""
    of = positives.groupBy("anchor_id", "key").agg(F.collect_list(F.struct(F.col("rank").alias("nth"), "score")).alias("w"))
    at = chunks.select("part", F.posexplode(F.arrays_zip("ids", "keys")).alias("pos", "q")).select("part", "pos", F.col("q.ids").alias("anchor_id"), F.col("q.keys").alias("key"))
    empty = F.array().cast("array<struct<nth:int,score:bigint>>")
    lists = at.join(of, ["anchor_id", "key"], "left").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("w", empty).alias("w")))).alias("s"))
    return chunks.join(lists.select("part", F.col("s.w").alias("windows")), "part")


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, every: int = 50, scale: float = 256.0, width: int = 2, sample_rows: int = 8192, rounds: int = 8, block_rows: int = 8192, chunk_rows: int = 16384, seed: int = 11) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding. Anchors are rows whose id is divisible by `every`; a window goes from `least` to
    `most` percent of a positive's score."""
    spark = vectors.sparkSession
    known = vectors.where("label IS NOT NULL").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    x = stored(usable(known, "label").withColumn("v", whole_components("v", scale)), "mining-vectors")
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    n, q, dim = x.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v"))).first()
    if not q:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    sample = x.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(sample_rows).select("v").toArrow()
    books = Codebooks(sample.column("v").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1), width, rounds, seed)
    blocks, chunks = (parts(rows * max(dim, 64), 64 * per) for rows, per in ((n, block_rows), (q, chunk_rows)))
    asked = x.where(is_anchor).distinct()
    b = dealt(x.select(F.col("vec_id").alias("ids"), F.lit(0).cast("bigint").alias("keys"), F.col("label").alias("labels"), "v"), blocks, books, "mining-blocks")
    c = dealt(asked.select(F.col("vec_id").alias("ids"), F.xxhash64("v", "label").alias("keys"), F.col("label").alias("labels"), "v"), chunks, None, "mining-anchors")
    best = stored(merged(in_cells(b, c, blocks, chunks, _positives(books, positives), HIT), positives, "anchor_id", "key").drop("nth"), "mining-positives")
    found = merged(in_cells(b, with_windows(c, best), blocks, chunks, _negatives(books, negatives, least, most), HIT), negatives, "anchor_id", "key", "nth")
    best = best.select("anchor_id", "key", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(best, ["anchor_id", "key", "nth"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", "embedding", moved.alias("label")))


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS a, c.vec_id AS c, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS s
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
pos AS (SELECT a, c, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
r AS (SELECT pos.a, pos.c, pos.s, p.c AS n, p.s AS ns, row_number() OVER (PARTITION BY pos.a, pos.c ORDER BY p.s DESC, p.c) AS rank
  FROM pos JOIN p ON p.a = pos.a AND NOT p.same AND 50 * pos.s <= 100 * p.s AND 100 * p.s <= 95 * pos.s)
SELECT a AS anchor_id, c AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, s AS positive_score, ns AS negative_score FROM r WHERE rank <= 3
"""
