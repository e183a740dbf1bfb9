"""Alignment of two tokenizers by a dictionary of groups.

A text (with a space before it) is encoded by A, a byte-level BPE, and by B, a piece model; both spell the same bytes. The
byte offsets where tokens of both end cut them into groups, the smallest stretches that both cover with whole tokens. Every
A token of a group is linked with every B token of it.

Few distinct groups make up most of a corpus, so nothing is expanded by occurrence:
1. Documents are encoded in chunks of some MB. A chunk interns its groups: its dictionary holds each distinct group once
   (as text `a1,a2|b1`), with the number of its documents that hold it; documents hold numbers in that dictionary.
   A document that holds an id pair through k different groups would count k times below, so the chunk also reports k - 1
   too many for the pair. All is written to the shared folder.
2. Dictionaries are merged: documents per distinct group.
3. Each distinct group is expanded once into its id pairs; a pair's count is the sum of its groups' documents, less what
   the chunks report. The best count of each A id follows.
4. Each distinct group gets the sums over its links; they are joined back to the chunks' dictionaries by group, and each
   chunk's documents add up what their numbers stand for.

Defined cases: texts that are null or empty, or whose tokens don't spell the text (unknown characters of a tokenizer
without bytes, white space dropped), have no tokens: zeros and an empty hash; every row is a document of its own, so
repeated rows count each, with null ids too; very long texts are a chunk of their own; extra columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points of text in a chunk.
CHUNK = 1 << 22


@lru_cache(1)
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, a: str, b: str):
        with open(a, encoding="utf-8") as f:
            rules = json.load(f)
        if rules["model"]["type"] != "BPE" or rules["normalizer"] or rules["pre_tokenizer"]["type"] != "ByteLevel" or rules["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{a} is no byte-level BPE without a normalizer")
        special = {t["content"] for t in rules["added_tokens"]}
        ranks = {bytes(byte_of()[c] for c in token): i for token, i in rules["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where they don't spell it."""
        none = np.zeros(0, np.int64)
        a, b = [], []
        for text, of_b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            spelled = (" " + text).encode() if text else b""
            of_a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64) if text else none
            same = text and b"".join(map(self.a_bytes.__getitem__, of_a.tolist())) == spelled == b"".join(map(self.b_bytes.__getitem__, of_b))
            a.append(of_a if same else none)
            b.append(np.array(of_b, np.int64) if same else none)
        return a, b


@lru_cache(2)
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... n[i] of them, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


class Groups:
    """The groups of some documents' tokens, in order, and the distinct ones among them."""

    def __init__(self, v: Vocabularies, a: list[np.ndarray], b: list[np.ndarray]):
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        self.a, self.b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
        a_ends, b_ends = np.cumsum(v.a_len[self.a]), np.cumsum(v.b_len[self.b])
        # A document's last tokens end together, so no group reaches into the next one.
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_end, self.b_end = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        self.a_n, self.b_n = np.diff(self.a_end, prepend=0), np.diff(self.b_end, prepend=0)
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.a_end - 1, "right")
        self.number, self.at = self._interned()

    def _key(self, salt: int) -> np.ndarray:
        """A hash of the ids of each group, of both sides and in order."""
        out = mixed(self.a_n.astype(np.uint64) << np.uint64(32) | self.b_n.astype(np.uint64)) + np.uint64(salt)
        for side, (ids, end, n) in enumerate(((self.a, self.a_end, self.a_n), (self.b, self.b_end, self.b_n))):
            place = spread(np.zeros(len(n), np.int64), n).astype(np.uint64)
            h = mixed(ids.astype(np.uint64) * np.uint64(2 + side) + mixed(place * np.uint64(2) + np.uint64(side + 7 + salt)))
            out += np.add.reduceat(h, end - n) if len(n) else np.zeros(0, np.uint64)
        return out

    def _interned(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each group's distinct group, and where each distinct group occurs first."""
        for salt in range(100):
            _, at, number = np.unique(self._key(salt), return_index=True, return_inverse=True)
            first = at[number]
            if all(np.array_equal(n, n[first]) and np.array_equal(ids, ids[spread((end - n)[first], n)]) for ids, end, n in ((self.a, self.a_end, self.a_n), (self.b, self.b_end, self.b_n))):
                return number, at
        raise ArithmeticError("no salt tells the groups apart")

    def ids(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.a_end[at] - self.a_n[at] : self.a_end[at]], self.b[self.b_end[at] - self.b_n[at] : self.b_end[at]]

    def names(self) -> list[str]:
        """The distinct groups as text."""
        out = []
        for ids, end, n in ((self.a, self.a_end, self.a_n), (self.b, self.b_end, self.b_n)):
            ids = list(map(str, ids[spread((end - n)[self.at], n[self.at])].tolist()))
            to = np.cumsum(n[self.at])
            out.append([",".join(ids[i:j]) for i, j in zip((to - n[self.at]).tolist(), to.tolist(), strict=True)])
        return ["|".join(x) for x in zip(*out, strict=True)]

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the distinct groups, one group after the other, and how many each has; of A and of B."""
        return tuple(x for ids, end, n in ((self.a, self.a_end, self.a_n), (self.b, self.b_end, self.b_n)) for x in (ids[spread((end - n)[self.at], n[self.at])], n[self.at]))


#: Id pairs made at a time.
TABLE = 1 << 18


def crossed(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray):
    """(group, A id, B id, links) of the different id pairs of groups, some at a time; group numbers don't fall. a, a_n: the
    groups' A ids one after the other, and how many each has."""
    sides = []
    for ids, n in ((a, a_n), (b, b_n)):
        keys, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids, return_counts=True)
        sides.append((keys >> 32, keys & 0xFFFFFFFF, times))
    (a_of, a, a_times), (b_of, b, b_times) = sides
    n = np.bincount(b_of, minlength=len(b_n))
    begin, total = np.cumsum(n) - n, np.cumsum(n[a_of])
    at = 0
    while at < len(a_of):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TABLE, "right")))
        of = a_of[at:to]
        right = spread(begin[of], n[of])
        left = np.repeat(np.arange(at, to), n[of])
        yield a_of[left], a[left], b[right], a_times[left] * b_times[right]
        at = to


def distinct(doc: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (document, number) pairs in order, and how often each occurs."""
    keys, n = np.unique(doc * size + number, return_counts=True)
    return keys // max(size, 1), keys % max(size, 1), n


def surplus(g: Groups, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs, and by how much the sum over groups counts the documents of each too often. doc, number: different ones."""
    parts = [(of, a << 32 | b) for of, a, b, _ in crossed(*g.sides())]
    of, pairs = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.bincount(of, minlength=len(g.at))
    shared, place, uses = np.unique(pairs, return_inverse=True, return_counts=True)
    # Pairs of one group alone can't count twice.
    keep = uses[place] > 1
    left = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
    place, begin = place[keep], np.cumsum(left) - left
    at = place[spread(begin[number], left[number])]
    keys, k = np.unique(np.repeat(doc, left[number]) * len(shared) + at, return_counts=True)
    more = np.bincount((keys % max(len(shared), 1))[k > 1], k[k > 1] - 1, len(shared)).astype(np.int64)
    return shared[more > 0], more[more > 0]


CHUNKED = "chunk bigint, kind int, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, hash string, numbers array<int>, counts array<int>, number int, name string, a int, b int, n bigint"
DOCUMENT, GROUP, PAIR = 0, 1, 2


def _rows(kind: int, rows: int, schema: pa.Schema, chunk: int, **columns) -> pa.RecordBatch:
    have = {"chunk": pa.array(np.full(rows, chunk)), "kind": pa.array(np.full(rows, kind, np.int32))} | columns
    return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values.astype(np.int32)))


def aligned(v: Vocabularies, chunk: int, ids: pa.Array, texts: list[str | None], schema: pa.Schema):
    """The rows of one chunk: documents, dictionary, surplus."""
    g = Groups(v, *v.encode(texts))
    size, names = len(g.at), g.names()
    doc, number, n = distinct(g.doc, g.number, size)
    per_doc = np.bincount(g.doc, minlength=len(texts))
    per_list = np.bincount(doc, minlength=len(texts))
    links = np.bincount(g.doc, g.a_n * g.b_n, len(texts)).astype(np.int64)
    ends, numbers = np.cumsum(per_doc).tolist(), g.number.tolist()
    hashes = [hashlib.sha256(";".join(map(names.__getitem__, numbers[e - m : e])).encode()).hexdigest() if m else "" for e, m in zip(ends, per_doc.tolist(), strict=True)]
    yield _rows(DOCUMENT, len(texts), schema, chunk, doc_id=ids, n_a=pa.array(g.n_a), n_b=pa.array(g.n_b), n_groups=pa.array(per_doc), n_links=pa.array(links), hash=pa.array(hashes), numbers=_lists(number, per_list), counts=_lists(n, per_list))
    if size:
        yield _rows(GROUP, size, schema, chunk, number=pa.array(np.arange(size)), name=pa.array(names), n=pa.array(np.bincount(number, minlength=size)))
        pairs, more = surplus(g, doc, number)
        yield _rows(PAIR, len(pairs), schema, chunk, a=pa.array(pairs >> 32), b=pa.array(pairs & 0xFFFFFFFF), n=pa.array(more))


def _chunks(a: str, b: str, schema: pa.Schema):
    def run(batches):
        v, made, held, texts, size = vocabularies(a, b), TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                held.append(batch.column(0).slice(i, 1))
                texts.append(text)
                size += len(text or "")
                if size >= CHUNK:
                    yield from aligned(v, made, pa.concat_arrays(held), texts, schema)
                    made, held, texts, size = made + 1, [], [], 0
        if texts:
            yield from aligned(v, made, pa.concat_arrays(held), texts, schema)

    return run


def _expanded(batches):
    """Each group's id pairs, and how many of its links each has."""
    for batch in batches:
        sides = list(zip(*(x.split("|") for x in batch.column(0).to_pylist()), strict=True))
        ids = [x for side in sides for x in (np.fromstring(",".join(side), np.int64, sep=","), np.array([y.count(",") + 1 for y in side]))]
        for of, a, b, links in crossed(*ids) if sides else ():
            per_group = [c.take(pa.array(of)) for c in batch.columns]
            per_pair = [pa.array(x.astype(t)) for x, t in ((a, np.int32), (b, np.int32), (links, np.int64))]
            yield pa.RecordBatch.from_arrays([*per_group, *per_pair], ["name", "docs", "a", "b", "links"])


def _added(schema: pa.Schema):
    """The documents of a chunk with the sums over their groups."""

    def run(docs: pa.Table, groups: pa.Table) -> pa.Table:
        n = groups.num_rows
        at = groups.column("number").to_numpy() if n else np.zeros(0, np.int64)
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best[at], total[at] = (groups.column(c).to_numpy() for c in ("best", "total")) if n else (best, total)
        lists = docs.column("numbers").combine_chunks()
        number, times = lists.flatten().to_numpy(), docs.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        of = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy())
        sums = []
        for value in (best, total):
            out = np.zeros(docs.num_rows, np.int64)
            np.add.at(out, of, value[number] * times)
            sums.append(pa.array(out))
        have = {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs.column("hash")}
        return pa.table([have[f.name] if f.name in have else docs.column(f.name) for f in schema], schema=schema)

    return run


def align(docs: DataFrame, a: str = "", b: str = "") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row. a, b: tokenizer files."""
    spark = docs.sparkSession
    small_batches(spark)
    a, b = a or public_tokenizers.path(A), b or public_tokenizers.path(B)
    kind = dict(docs.dtypes)["doc_id"]
    schema = spark.createDataFrame([], CHUNKED.format(id=kind)).schema
    chunks = stored(docs.select("doc_id", "text").mapInArrow(_chunks(a, b, arrow_schema(schema)), schema), "alignment-chunks")
    of = {k: chunks.where(F.col("kind") == k) for k in (DOCUMENT, GROUP, PAIR)}
    groups = of[GROUP].groupBy("name").agg(F.sum("n").alias("docs"))
    links = stored(groups.mapInArrow(_expanded, "name string, docs bigint, a int, b int, links bigint"), "alignment-links")
    counts = links.select("a", "b", F.col("docs").alias("n")).unionByName(of[PAIR].select("a", "b", (-F.col("n")).alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = stored(counts, "alignment-counts")
    # One row for each id of A's vocabulary at most.
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    counts = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("bigint").alias("is_best"))
    sums = links.join(counts, ["a", "b"]).groupBy("name").agg(F.sum(F.col("links") * F.col("is_best")).alias("best"), F.sum(F.col("links") * F.col("n")).alias("total"))
    back = of[GROUP].select("chunk", "number", "name").join(sums, "name").select("chunk", "number", "best", "total")
    out = spark.createDataFrame([], f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").schema
    have = of[DOCUMENT].select(F.col("chunk").alias("of"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "hash", "numbers", "counts")
    return have.groupBy("of").cogroup(back.groupBy("chunk")).applyInArrow(_added(arrow_schema(out)), out)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
