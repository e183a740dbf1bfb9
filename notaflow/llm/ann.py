"""Approximate nearest neighbours by inner product: stable projections, kd-tree, chi-square stopping.

Largest inner product is turned into smallest distance: in each block of rows, a row gets one more component,
sqrt(M^2 - |x|^2) with M the block's largest norm, a query gets 0 there. Rows are projected by a fixed Gaussian (2-stable)
matrix to `dims` dimensions, where |projected difference|^2 / |difference|^2 follows a chi-square law with `dims` degrees
of freedom. Each block has a kd-tree over the projections. For a query the tree's leaves come in order of the distance
from the query's projection to their boxes, and the rows of a leaf are verified with exact inner products as far as the
stopping test lets them: a row is left out where a row as near as the kth found would have been projected nearer with
probability `confidence` (chi-square test), and the search of a block stops where that holds for all leaves to come. The
best k of all blocks are the answer. Expected recall of a kth neighbour is at least `confidence`.

A leaf's rows are multiplied with all queries that want some of them at once, as one product costs less than picking
pairs; a row that a query's test leaves out is not used for it, and `verified` counts those used. How many they are
hangs on the vectors: of independent ones in 64 dimensions, whose distances differ little, more than half.

Blocks are dealt at random, so any number of equal vectors or rows spreads; every row is in a tree.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components, and null ids, take no part;
vectors of another length than the most frequent one take no part; repeated rows are separate candidates; repeated
query rows ask once, and rows of one id with different vectors ask each on their own; ties go to the smaller id; with
fewer than k candidates all found are returned; huge finite components take part, and scores beyond the doubles are
infinite; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .topk import as_table, in_cells, laid_out, ranked, read, tiles, usable


def chi2_quantile(p: float, dof: int) -> float:
    """x with P(chi-square(dof) <= x) = p, for even dof, by bisection on the closed form."""
    assert dof % 2 == 0

    def below(x):
        term = total = math.exp(-x / 2)
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    lo, hi = 0.0, 10.0 * dof + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: the widest dimension is cut at the median, by count, so ties split too."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        p = points[own]
        dim = int(np.argmax(p.max(0) - p.min(0)))
        half = len(own) // 2
        order = np.argpartition(p[:, dim], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


class Block:
    """The rows of a block in the order of its tree's leaves, with their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dims: int, leaf: int, seed: int):
        # A power of two, so that scaling is exact; it keeps squares of huge components finite.
        self.scale = 2.0 ** -max(0, math.frexp(np.abs(x).max())[1] - 100)
        near = x * self.scale
        self.norm = float(np.sqrt((near**2).sum(1).max()))
        self.project = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, dims))
        extra = np.sqrt(np.maximum(0.0, self.norm**2 - (near**2).sum(1)))
        p = near @ self.project[:-1] + extra[:, None] * self.project[-1]
        leaves = kd_leaves(p, leaf)
        order = np.concatenate(leaves)  # a leaf's rows lie together
        self.ids, self.x, self.near, self.p = ids[order], x[order], near[order], p[order]
        self.begin = np.concatenate([[0], np.cumsum([len(m) for m in leaves])])
        self.low, self.high = (f.reduceat(self.p, self.begin[:-1], 0) for f in (np.minimum, np.maximum))
        self.p2 = (self.p**2).sum(1)


def search(block: Block, of: np.ndarray, q: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest found for each query: (query, row, score) and how many rows each query used. All queries take their next
    leaves in rounds, twice as many each time."""
    shrink = 2.0 ** -np.maximum(0, np.frexp(np.abs(q).max(1))[1] - 100)
    qs = q * shrink[:, None]
    pq, q2 = qs @ block.project[:-1], (qs**2).sum(1)
    leaves = len(block.begin) - 1
    box = np.zeros((len(q), leaves))
    for d in range(pq.shape[1]):
        box += np.maximum(0.0, np.maximum(block.low[None, :, d] - pq[:, d, None], pq[:, d, None] - block.high[None, :, d])) ** 2
    place = np.argsort(np.argsort(box, 1, kind="stable"), 1)  # a leaf's place in a query's order
    far = (pq**2).sum(1)[:, None] + block.p2[None, :] - 2 * (pq @ block.p.T)  # distance in the projection
    own = of[:, None] == block.ids[None, :]
    found, used, kth, at, more = np.full(own.shape, -np.inf), np.zeros(len(q), np.int64), np.full(len(q), -np.inf), 0, 2
    while at < leaves:
        reach = np.where(np.isfinite(kth), bar * np.maximum(0.0, block.norm**2 + q2 - 2 * kth), np.inf)
        want = (place >= at) & (place < at + more) & (box <= reach[:, None])
        for j in np.flatnonzero(want.any(0)):
            who, part = np.flatnonzero(want[:, j]), slice(block.begin[j], block.begin[j + 1])
            near = (far[who, part] <= reach[who, None]) & ~own[who, part]
            found[who, part] = np.where(near, qs[who] @ block.near[part].T, -np.inf)
            used[who] += near.sum(1)
        at, more = at + more, more * 2
        if own.shape[1] > k:
            kth = np.partition(found, own.shape[1] - k, 1)[:, own.shape[1] - k]
        if not ((place >= at) & (box <= np.where(np.isfinite(kth), bar * np.maximum(0.0, block.norm**2 + q2 - 2 * kth), np.inf)[:, None])).any():
            break
    slack = 1e-12 * block.norm * np.sqrt(q2)  # products of matrices and of pairs differ by less
    i, j = np.nonzero((found >= (kth - slack)[:, None]) & np.isfinite(found))
    exact = np.concatenate([scores(block, q, qs, shrink, i[c : c + 65536], j[c : c + 65536]) for c in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
    order = np.lexsort((block.ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[keep], j[keep], exact[keep], used


def scores(block: Block, q: np.ndarray, qs: np.ndarray, shrink: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the original vectors; where partial sums leave the doubles, of the scaled ones, scaled back."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (q[i] * block.x[j]).sum(1)
        odd = ~np.isfinite(out)
        out[odd] = (qs[i[odd]] * block.near[j[odd]]).sum(1) / shrink[i[odd]] / block.scale
    return out


FOUND = "query_id bigint, key bigint, vec_id bigint, score double, verified bigint, of_rows bigint"


def _searcher(k: int, dims: int, bar: float, leaf: int, seed: int):
    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        (ids, _, x), (of, keys, q) = read(block), read(chunk)
        if not len(ids) or not len(of):
            return as_table(FOUND, [])
        rows, out = Block(ids, x, dims, leaf, seed), []
        for t in tiles(len(of)):
            i, j, score, used = search(rows, of[t], q[t], k, bar)
            out.append([of[t][i], keys[t][i], rows.ids[j], score, used[i], np.full(len(i), len(ids))])
        return as_table(FOUND, out)

    return run


def projected_search(vectors: DataFrame, k: int = 20, every: int = 20, dims: int = 24, confidence: float = 0.93, leaf: int = 64, block_rows: int = 8192, chunk_rows: int = 16384, seed: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by `every`, against all rows; and of the block that
    the neighbour was found in, how many rows the query verified, of how many."""
    x = stored(usable(vectors).where(F.exists("v", lambda c: c != 0)), "ann-vectors")
    laid = laid_out(x, every, block_rows, chunk_rows, "ann")
    if not laid:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint, of_rows bigint")
    hits = in_cells(*laid, _searcher(k, dims, chi2_quantile(confidence, dims), leaf, seed), FOUND)
    return ranked(hits, k).select("query_id", "rank", "vec_id", "score", "verified", "of_rows")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search(table(spark, sf_dir, "embeddings"))
