"""Similarity join of word shingle sets (Jaccard) by PartEnum signatures.

Equal sets are one class; only classes are joined. Sizes fall into bands [l, l * 100 / percent]; sets that are similar
enough are in the same band or in neighbouring ones, so each set is treated in its own band and in the next. In a band
whose largest size is r, similar sets differ in at most k = 2 r (100 - percent) / (100 + percent) shingles. The domain
of shingles is split into n1 = ceil((k + 1) / 2) parts, one of which holds at most one difference; each part is split
into 3, of which 2 then agree. Each choice of 2 is enumerated, and the hash of the set's shingles there is a signature:
similar sets share one. (k = 0: the whole set.)

Signatures of large sets cover few shingles, so unlike sets can share one by chance. Each class therefore has a parity
sketch: bit i says whether an odd number of its hashes fall into cell i. Two sketches never differ in more bits than the
sets in shingles, so a pair whose sketches differ in more than similar sets may is not similar; that drops the chance
pairs and no other. Within each signature's classes the remaining pairs give groups of candidates: small buckets name
their pairs, larger ones only a spanning forest, and large ones are cut into blocks, block against block.
A group is then cut into blocks of about `block` classes; each pair of blocks of a group is verified exactly, by one
matrix product on 0/1 incidence, and gives only a spanning forest of its links. Components of these forests are the
components of all links: no link is lost, and copies and near copies never become a list of all pairs.

Hashes have 64 bits: sets and shingles are told apart by them (for N classes, N^2 / 2^65 false merges are expected).

Defined cases: a null, empty or blank text has an empty set, n_shingles 0, and is linked with nothing (its component_id
is its own doc_id); a row without doc_id is compared like any other, and its component_id is the smallest doc_id of its
group, null where the group has none; repeated rows and repeated ids each give a row; very long texts are sets like any
other; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, small_batches, stored, table
from .components import components
from .shingles import STEP, mixed, set_class, shingle_sets


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size bands, and the most differences of similar sets in each."""
    low, end = [1], []
    while low[-1] <= largest:
        end.append(max(low[-1], low[-1] * 100 // percent))
        low.append(end[-1] + 1)
    end.append(max(low[-1], low[-1] * 100 // percent))
    low.append(end[-1] + 1)
    end.append(max(low[-1], low[-1] * 100 // percent))
    return np.array(low), np.array(end) * 2 * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and which set each belongs to."""
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, most = bands(percent, int(n.max()))
    own = np.searchsorted(low, n, "right") - 1
    of, value = np.repeat(np.arange(len(n)), n), mixed(s ^ STEP[2])
    half = np.uint64(32)
    sigs, whose = [], []
    with np.errstate(over="ignore"):
        for band in (own, own + 1):
            k = np.where(n > 0, most[np.maximum(band, 0)], 0)
            n1 = np.where(k == 0, 1, (k + 2) // 2)
            cells = np.where(n == 0, 0, np.where(k == 0, 1, 3 * n1))
            off = np.cumsum(cells) - cells
            at = off[of] + (s % cells[of].astype(np.uint64)).astype(np.int64)
            total = int(cells.sum())
            # Two halves, so that sums in doubles are exact.
            lo = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
            hi = np.bincount(at, (value >> half).astype(float), total).astype(np.uint64)
            x = lo + (hi << half)
            tag = mixed(band.astype(np.uint64) * STEP[0])
            one = np.flatnonzero((n > 0) & (k == 0))
            sigs.append(mixed(x[off[one]] + tag[one]))
            whose.append(one)
            more = np.flatnonzero((n > 0) & (k > 0))
            m = n1[more]
            doc = np.repeat(more, m)
            part = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)
            first = off[doc] + 3 * part
            for i, (a, b) in enumerate(((0, 1), (1, 2), (0, 2))):
                sigs.append(mixed(mixed(x[first + a]) * STEP[1] + x[first + b] + tag[doc] + (3 * part + i).astype(np.uint64) * STEP[3]))
                whose.append(doc)
    return np.concatenate(sigs), np.concatenate(whose)


def sketches(s: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: as many bits as the next power of two above its size, 64 at least."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    off = np.cumsum(bits) - bits
    at = np.repeat(off, n) + (s % np.repeat(bits, n).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [odd[o // 8 : (o + b) // 8].tobytes() if k else b"" for o, b, k in zip(off.tolist(), bits.tolist(), n.tolist(), strict=True)]


def named(words: int):
    """Arrow batches of (doc_id, key, text) to (doc_id, key, n, cls, sketch); a class's sketch comes once a task."""

    def run(batches):
        seen = set()
        for b in batches:
            s, n = shingle_sets(b.column(2).to_pylist(), words)
            cls = set_class(s, n).view(np.int64)
            sketch = sketches(s, n)
            for i, c in enumerate(cls.tolist()):
                if not n[i] or c in seen:
                    sketch[i] = None
                seen.add(c)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n, pa.int64()), pa.array(cls), pa.array(sketch, pa.binary())], ["doc_id", "key", "n", "cls", "sketch"])

    return run


def signed(words: int, percent: int):
    """Arrow batches of (text) to (sig, cls), each class once a task."""

    def run(batches):
        seen = set()
        for b in batches:
            s, n = shingle_sets(b.column(0).to_pylist(), words)
            cls = set_class(s, n)
            new = np.zeros(len(n), bool)
            for i, c in enumerate(cls.tolist()):
                new[i] = bool(n[i]) and c not in seen
                seen.add(c)
            sig, of = signatures(s[np.repeat(new, n)], np.where(new, n, 0), percent)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls.view(np.int64)[of])], ["sig", "cls"])

    return run


class Sketches:
    """Sketches of many sets, compared at the smaller length of a pair: the longer one is folded."""

    def __init__(self, sketch: list[bytes], n: np.ndarray):
        self.n, self.words = n.astype(np.int64), np.array([len(x) // 8 for x in sketch])
        self.at, self.rows = {}, {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self._put(w, own, np.frombuffer(b"".join(sketch[i] for i in own), np.uint64).reshape(-1, w))
        for w in sorted(self.rows):
            longer = np.flatnonzero(self.words == 2 * w)
            if len(longer):
                x = self.rows[2 * w][self.at[2 * w][longer]]
                self._put(w, longer, x[:, :w] ^ x[:, w:])

    def _put(self, w: int, own: np.ndarray, x: np.ndarray) -> None:
        old = self.rows.get(w, np.zeros((0, w), np.uint64))
        place = self.at.setdefault(w, np.full(len(self.n), -1))
        place[own] = len(old) + np.arange(len(own))
        self.rows[w] = np.concatenate([old, x])

    def near(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether pairs of sets may be similar."""
        most = (self.n[a] + self.n[b]) * (100 - percent) // (100 + percent)
        w = np.minimum(self.words[a], self.words[b])
        out = (np.maximum(self.words[a], self.words[b]) <= 2 * w) & (np.abs(self.n[a] - self.n[b]) <= most)
        for size in np.unique(w[out]).tolist():
            for i in np.array_split(np.flatnonzero(out & (w == size)), 1 + len(a) * size // 4_000_000):
                x, place = self.rows[size], self.at[size]
                out[i] = np.bitwise_count(x[place[a[i]]] ^ x[place[b[i]]]).sum(1) <= most[i]
        return out


def star(ok: np.ndarray, cls: np.ndarray) -> tuple[list, list]:
    """Edges of a star over each component of a link matrix."""
    a, b, todo = [], [], np.ones(len(cls), bool)
    while todo.any():
        group = np.zeros(len(cls), bool)
        group[np.argmax(todo)] = True
        edge = group
        while edge.any():
            edge = ok[edge].any(0) & ~group
            group = group | edge
        todo &= ~group
        own = cls[group]
        a += [own.min()] * (len(own) - 1)
        b += own[own != own.min()].tolist()
    return a, b


def bucket_forest(percent: int, small: int = 6):
    """Groups of (sig, i, j, cls, n, sketch): edges between classes of one bucket that may be similar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["sig", "i", "j", "cls"]).sort_values(["sig", "i", "j"], kind="stable")
        cls = pdf.cls.to_numpy()
        known, index = np.unique(cls, return_index=True)
        sk = Sketches([bytes(x) for x in pdf.sketch.iloc[index]], pdf.n.to_numpy()[index])
        of = np.searchsorted(known, cls)
        keys = pdf[["sig", "i", "j"]].to_numpy()
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(keys)))
        bucket = np.repeat(np.arange(len(begin)), size)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        few = (size <= small)[bucket]
        for d in range(1, small):
            i = np.flatnonzero((bucket[:-d] == bucket[d:]) & few[d:]) if len(bucket) > d else np.zeros(0, np.int64)
            pairs = np.unique(np.sort(np.stack([of[i], of[i + d]], 1), 1), axis=0)
            pairs = pairs[sk.near(pairs[:, 0], pairs[:, 1], percent)] if len(pairs) else pairs
            out_a.append(known[pairs[:, 0]])
            out_b.append(known[pairs[:, 1]])
        for k in np.flatnonzero(size > small):
            own = of[begin[k] : begin[k] + size[k]]
            m = len(own)
            x, y = np.triu_indices(m, 1)
            ok = np.zeros((m, m), bool)
            ok[x, y] = sk.near(own[x], own[y], percent)
            a, b = star(ok | ok.T, known[own])
            out_a.append(np.array(a, np.int64))
            out_b.append(np.array(b, np.int64))
        edges = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def hashed(doc_words: int):
    """Arrow batches of (cls, comp, blocks, text) to the same with the set, where the text is of that class; each class once
    a task, as repeated rows have one key."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            s, n = shingle_sets(b.column(3).to_pylist(), doc_words)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            same = set_class(s, n).view(np.int64) == b.column(0).to_numpy()
            for i, c in enumerate(b.column(0).to_pylist()):
                if same[i]:
                    same[i] = c not in seen
                    seen.add(c)
            same = pa.array(same)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(at, pa.array(s.view(np.int64)))], ["cls", "comp", "blocks", "h"]).filter(same)

    return run


def links(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Which sets are similar enough, as a matrix; exact."""
    n = np.array([len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    both = count[col] > 1  # a shingle of one set alone is in no intersection
    names = np.cumsum(count > 1) - 1
    row, col = row[both], names[col[both]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(sets), len(sets)))
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        i, j = np.searchsorted(col, (c, c + columns))
        a = np.zeros((len(sets), min(columns, int(col[-1]) + 1 - c)), np.float32)
        a[row[i:j], col[i:j] - c] = 1
        inter += a @ a.T
    union = n[:, None] + n[None, :] - inter
    return 100 * inter >= percent * union


def forest(percent: int):
    """Groups of (comp, i, j, cls, h): a star over each component of links within a pair of blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, g in pdf.groupby(["comp", "i", "j"], sort=False):
            g = g.drop_duplicates("cls")
            if len(g) < 2:
                continue
            a, b = star(links([np.asarray(x) for x in g.h], percent), g.cls.to_numpy())
            out_a += a
            out_b += b
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    return run


def grid(rows: DataFrame, many: str, *columns: str) -> DataFrame:
    """Each row for every pair (i, j) of parts that holds its own part; `many` parts there are."""
    d = rows.select(*columns, "own", F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias("other"))
    return d.select(*columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 256, task_rows: int = 1500, bucket: int = 512) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row: component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    small_batches(spark)
    # A class's text is found again by id and text, as ids may be shared or missing.
    key = F.xxhash64("doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), "text")
    t = stored(texts.mapInArrow(named(words), "doc_id bigint, key bigint, n bigint, cls bigint, sketch binary"), "jaccard-named")
    classes = t.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("key").alias("found by"))
    sigs = texts.select("text").mapInArrow(signed(words, percent), "sig bigint, cls bigint")
    same = W.partitionBy("sig")
    shared = sigs.withColumns({"m": F.count("*").over(same), "least": F.min("cls").over(same), "most": F.max("cls").over(same)}).where("least <> most")
    shared = stored(shared.select("sig", "cls", "m"), "jaccard-shared")
    shared = shared.withColumn("parts", F.ceil(F.col("m") / bucket).cast("int"))
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    cells, cell_rows = grid(shared.withColumn("own", own), "parts", "sig", "cls"), shared.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    sketch = t.where("sketch IS NOT NULL").select("cls", "n", "sketch").dropDuplicates(["cls"])
    task = F.pmod(F.xxhash64("sig", "i", "j"), F.lit(parts(cell_rows, 10_000) * 4)).alias("task")
    near = components(cells.join(sketch, "cls").withColumn("task", task).groupBy("task").applyInPandas(bucket_forest(percent), "a bigint, b bigint"))
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = near.join(sizes, "root").select(F.col("node").alias("cls"), F.col("root").alias("comp"), "blocks")
    member = stored(member.join(classes, "cls"), "jaccard-candidates")
    rows = member.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    sets = member.hint("shuffle_merge").join(texts, F.col("found by") == F.col("key")).select("cls", "comp", "blocks", "text")
    sets = sets.mapInArrow(hashed(words), "cls bigint, comp bigint, blocks int, h array<bigint>")
    dealt = grid(sets.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "blocks", "comp", "cls", "h")
    task = F.pmod(F.xxhash64("comp", "i", "j"), F.lit(parts(rows, task_rows) * 4)).alias("task")
    edges = dealt.withColumn("task", task).groupBy("task").applyInPandas(forest(percent), "a bigint, b bigint")
    linked = components(edges)
    root = F.coalesce("root", "cls")
    final = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", root.alias("root"))
    ids = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = stored(final.join(ids, "root").select("cls", "rep", "component_id"), "jaccard-final")
    kept = t.where("n > 0").join(final, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), "component_id")
    rest = t.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return kept.unionByName(rest)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")
