"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's evidence is its own features and those of the line before and after
(character classes, word lengths, repetition), each cut into bins with a weight per label; neighbouring labels have
transition weights. The model is trained on lines that carry their document's label, on at most `sample_docs` labelled
documents (the ones with the smallest hash of the id) with at most `sample_lines` lines together. A document's evidence is the length-weighted mean of the forward-
backward marginals of "good"; a logistic curve fitted on the same sample turns it into a score.

Training rows have crc32(doc_id as text) mod 3 other than 1. Only the text is an input of a score.

Defined cases: a null or empty text is one empty line; null labels, and labels other than 0 and 1, are no labels; of
repeated labels of one doc_id the smallest counts, and of different texts of one labelled doc_id the one with the smallest
hash is trained on; repeated rows each give a row; rows without doc_id are scored, have no label and are not held out;
without labelled rows every score is 0.5; a very long text is scored whole, but trains only if its lines fit the sample;
extra columns are ignored; no documents give no rows, whatever labels there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table
from .shingles import words

KINDS = 12  # upper, lower, digit, space, full stop, comma, exclamation, bar, quote or bracket, symbol, beyond ASCII, other
KIND = np.full(256, 11, np.int64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", ".", ",", "!?", "|", "\"'()[]-:;", "#$%&*@+=<>/\\^_~`{}")):
    KIND[[ord(c) for c in _chars]] = _i
KIND[128:] = 10
NAMES = KINDS + 7
BINS = 10


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw features of every line, each line's length in bytes, and the number of lines of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    lines = [x.split(b"\n") for x in raw]
    n = np.array([len(x) for x in lines], np.int64)
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    line = np.cumsum(joined == 10) - (joined == 10)
    total = int(n.sum())
    body = joined != 10
    counts = np.bincount(line[body] * KINDS + KIND[joined[body]], minlength=total * KINDS).reshape(total, KINDS).astype(float)
    length = counts.sum(1)
    share = counts / np.maximum(length, 1)[:, None]
    h, w = words([y.decode("utf-8", "replace") for x in lines for y in x])
    of = np.repeat(np.arange(total), w)
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=total)
    doc = np.repeat(np.arange(len(texts)), n)
    key = [hash(y) for x in lines for y in x]
    seen: dict = {}
    for d, k in zip(doc.tolist(), key, strict=True):
        seen[d, k] = seen.get((d, k), 0) + 1
    copies = np.array([seen[d, k] for d, k in zip(doc.tolist(), key, strict=True)])
    doc_words, doc_of = np.bincount(doc, w, len(texts)), doc[of]
    order = np.lexsort((h, doc_of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc_of[order][1:] != doc_of[order][:-1])
    doc_distinct = np.bincount(doc_of[order][new], minlength=len(texts)) / np.maximum(1, doc_words)
    more = np.stack([np.log1p(length), np.log1p(w), length / np.maximum(1, w), distinct / np.maximum(1, w), copies, doc_distinct[doc], np.log1p(n)[doc]], 1)
    return np.concatenate([share, more], 1), length, n


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], "right")
    return out


def neighbours(b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bin numbers of a line, of the one before and of the one after; BINS + 1 where there is none."""
    first = np.cumsum(n) - n
    before, after = np.roll(b, 1, 0), np.roll(b, -1, 0)
    before[first] = BINS + 1
    after[first + n - 1] = BINS + 1
    return np.concatenate([b, before, after], 1)


def unary(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """w (features, bins): evidence for "good" of every line."""
    s = np.zeros(len(b))
    for j in range(b.shape[1]):
        s += w[j, b[:, j]]
    return s


def marginals(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts side by side: P(good) of each line, and the expected transitions (2, 2)."""
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    steps = int(n.max())
    active = np.searchsorted(-n[order], -np.arange(steps), "left")
    e = np.exp(t - t.max())
    good = np.exp(np.clip(s, -30, 30))
    fw, bw = np.zeros((len(s), 2)), np.ones((len(s), 2))
    for i in range(steps):
        at = first[order[: active[i]]] + i
        x = np.stack([np.ones(len(at)), good[at]], 1)
        if i:
            x = x * (fw[at - 1] @ e)
        fw[at] = x / x.sum(1, keepdims=True)
    for i in range(steps - 2, -1, -1):
        at = first[order[: active[i + 1]]] + i
        x = (np.stack([np.ones(len(at)), good[at + 1]], 1) * bw[at + 1]) @ e.T
        bw[at] = x / x.sum(1, keepdims=True)
    m = fw * bw
    m /= m.sum(1, keepdims=True)
    pair = np.zeros((2, 2))
    has = np.ones(len(s), bool)
    has[first + n - 1] = False
    at = np.flatnonzero(has)
    if len(at):
        right = np.stack([np.ones(len(at)), good[at + 1]], 1) * bw[at + 1]
        p = fw[at][:, :, None] * e[None] * right[:, None, :]
        pair = (p / p.sum((1, 2), keepdims=True)).sum(0)
    return m[:, 1], pair


def weighted(m: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(n)), n)
    return np.bincount(doc, m * (length + 1), len(n)) / np.bincount(doc, length + 1, len(n))


def train(x: np.ndarray, length: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1.0) -> dict:
    """Weights from line features and document labels, by Adam on the CRF likelihood."""
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:]) for j in range(x.shape[1])])
    b = neighbours(binned(x, edges), n)
    w, t = np.zeros((b.shape[1], BINS + 2)), np.zeros((2, 2))
    label = np.repeat(y, n).astype(float)
    ends = np.cumsum(n) - 1
    same = np.array([[np.sum((1 - y) * (n - 1)), 0], [0, np.sum(y * (n - 1))]], float)
    scale = 1 / max(1, len(ends))
    mw = vw = mt = vt = 0.0
    for i in range(1, rounds + 1):
        m, pair = marginals(unary(w, b), t, n)
        off = label - m
        gw = np.stack([np.bincount(b[:, j], off, BINS + 2) for j in range(b.shape[1])]) - ridge * w
        gt = same - pair - ridge * t
        gw, gt = gw * scale, gt * scale
        mw, vw, mt, vt = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        rate = 0.1 * min(1, 2 - 2 * i / (rounds + 1))
        w = w + rate * mw / (1 - 0.9**i) / (np.sqrt(vw / (1 - 0.99**i)) + 1e-8)
        t = t + rate * mt / (1 - 0.9**i) / (np.sqrt(vt / (1 - 0.99**i)) + 1e-8)
    z = evidence(weighted(marginals(unary(w, b), t, n)[0], length, n))
    a, c = 1.0, 0.0
    for _ in range(200):  # the curve from evidence to score
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        a, c = a + 0.05 * (np.mean((y - p) * z) - 1e-3 * a), c + 0.05 * np.mean(y - p)
    return {"edges": edges, "w": w, "t": t, "curve": (a, c)}


def evidence(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def scores(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x, length, n = line_features(texts)
    m, _ = marginals(unary(model["w"], neighbours(binned(x, model["edges"]), n)), model["t"], n)
    a, c = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * evidence(weighted(m, length, n)) + c, -30, 30)))


def _features(batches):
    for b in batches:
        x, length, n = line_features(b.column(1).to_pylist())
        at = np.concatenate([[0], np.cumsum(n)])
        flat = pa.array(np.concatenate([x, length[:, None]], 1).ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at * (NAMES + 1), pa.int32()), flat)], ["y", "x"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_lines: int = 200_000) -> dict | None:
    """The model, from at most `sample_docs` labelled documents outside the held-out part, of at most `sample_lines` lines."""
    small_batches(docs.sparkSession)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    few = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # The window sees the sample alone.
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    upto = F.sum("lines").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    few = few.withColumn("lines", lines).where(F.col("lines") <= sample_lines // 10).withColumn("upto", upto).where(F.col("upto") <= sample_lines)
    rows = few.select("y", "text").mapInArrow(_features, "y double, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    y = rows.column("y").to_numpy()
    per = [np.asarray(v).reshape(-1, NAMES + 1) for v in rows.column("x").to_numpy()]
    n, x = np.array([len(v) for v in per]), np.concatenate(per)
    return train(x[:, :-1], x[:, -1], n, y)


def scorer(model: dict | None):
    def run(batches):
        for b in batches:
            s = scores(model, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample_docs: int = 4000) -> DataFrame:
    """The columns in `keep`, score (0 to 1) and predicted (1: good) of every row."""
    model = fit(docs, labels, sample_docs)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double"
    out = docs.select(*keep, F.col("text").alias("text to score")).mapInArrow(scorer(model), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
