"""Token-id files: adaptive context mixing and a range coder, in independent checksummed blocks.

Format. A file row is a frame: frame number, ids of its documents, how many token ids each has, and a payload:
  "TF2\\n", bits of the largest id, number of blocks (uint32), then for each block its ids, its bytes and the crc32 of its
  ids (three uint32, little endian), then the blocks' bytes one after the other.
A block holds up to 65536 ids and starts from an empty model, so it can be read alone; its checksum is tested on reading.
Frames lie in Parquet files as rows (shard, frame, doc_ids, sizes, payload), a container that Spark can write and read
in any store.

Model, per block. Order 2 (a hash of the last two ids) and order 1 (of the last one) each remember the id that followed,
with a confidence. One decision says whether the next id is the order-2 prediction, a second one (where it differs)
whether it is the order-1 prediction. Their probabilities mix three adaptive estimates (by both confidences; by what held
for the last four ids; by order 1's confidence and agreement), weighted in the logistic domain by how well each did.
Otherwise the id is coded by order 0: its bits from the highest on, each with an adaptive probability given those before.
All decisions go through one binary range coder. The arithmetic is on integers, so every machine reads what another wrote.
The coder runs in the JVM (TokenCoder.java), the tokenizer in Python.

Defined cases: a null or empty text is the end id alone; very long texts are cut by nothing but block ends; repeated rows
each keep their place (ties in doc_id are ordered by the text's hash; equal rows are alike, and may lie in several
shards); null ids come first; no rows give no frames; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from ..session import shared_dir
from .common import on_exit_deleted, small_batches, stored, table
from .jvm import java_functions

VOCABULARY = "word_bpe_49k.json"
#: What a tokenizer file has to say for chunks between blanks to be encoded on their own.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that are composed, have one lower-case letter, and so pass the normalizer one by one.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"
MARKS = '.,;:!?$&*%#"()+=/@_|~-'
PLAIN = rf"^[{LETTERS}]+[{re.escape(MARKS)}]*$"


@lru_cache(2)
def tokenizer(path: str) -> tuple[Tokenizer, Tokenizer | None, np.ndarray]:
    """The tokenizer; its model alone for words that need no normalizer, where its rules allow that; which ids end a word."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rules = json.loads(t.to_str())
    pre, end = rules["pre_tokenizer"] or {}, rules["model"].get("end_of_word_suffix")
    first = (pre.get("pretokenizers") or [{}])[0]
    known = rules["normalizer"] == NORMALIZER and first.get("pattern") == {"Regex": SPLIT} and len(pre["pretokenizers"]) == 2 and not pre["pretokenizers"][1]["add_prefix_space"]
    known = known and bool(end) and not rules["model"].get("continuing_subword_prefix") and all(re.search(rf"[^{LETTERS}{re.escape(MARKS)}]", x["content"]) for x in rules["added_tokens"])
    words = None
    vocab = t.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    if known:
        t.model._resize_cache(0)  # words come once, so its cache would only cost
        words = Tokenizer(t.model)
        words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        ends[[i for x, i in vocab.items() if x.endswith(end)]] = True
    return t, words, ends


class Encoder:
    """Whole texts to ids. This tokenizer drops white space before it looks at anything, so a text's ids are the ids of its
    chunks between blanks and line ends, one after the other, and equal chunks are encoded once. A chunk of letters and
    closing marks is two words to the tokenizer, the letters in lower case and the marks, whose spelling its model takes
    as it is; all others go through the whole tokenizer. With another tokenizer, whole texts do."""

    def __init__(self, path: str, end: int, keep: int = 2_000_000):
        self.whole, self.words, self.ends = tokenizer(path)
        self.end, self.keep = end, keep
        self.clear()

    def clear(self) -> None:
        """Chunk 0 is the end of a text."""
        self.known = pa.array([], pa.large_string())
        self.ids, self.begin, self.size = np.array([self.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def encoded(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]

    def spelled(self, words: list[str], many: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has: the last id of a word says that it ends one."""
        joined = [" ".join(words[i : i + many]) for i in range(0, len(words), many)]
        got = self.words.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in got]) if got else np.zeros(0, np.int32)
        last = np.flatnonzero(self.ends[ids])
        assert len(last) == len(words)
        return ids, np.diff(last, prepend=-1)

    def learn(self, new: pa.Array) -> None:
        plain = pc.match_substring_regex(new, PLAIN)
        easy, rest = new.filter(plain), new.filter(pc.invert(plain))
        hard = rest.to_pylist()
        stem = pc.utf8_rtrim(easy, MARKS)
        mark = pc.replace_substring_regex(easy, f"^[{LETTERS}]+", "")
        words = pc.utf8_lower(stem).dictionary_encode()
        marks = mark.dictionary_encode()
        w_ids, w_n = self.spelled(words.dictionary.to_pylist())
        m_list = [x for x in marks.dictionary.to_pylist() if x]
        m_ids, m_n = self.spelled(m_list)
        empty = np.array([not x for x in marks.dictionary.to_pylist()], bool)
        m_size = np.zeros(len(empty), np.int64)
        m_size[~empty] = m_n
        h = self.encoded(hard)
        h_n = np.array([len(x) for x in h], np.int64)
        # A pool of words, marks and hard chunks; a chunk takes a piece or two of it.
        pool = np.concatenate([w_ids, m_ids, np.fromiter((i for x in h for i in x), np.int32, int(h_n.sum()))])
        a, b = words.indices.to_numpy(), marks.indices.to_numpy()
        w_at, m_at = np.cumsum(w_n) - w_n, len(w_ids) + np.cumsum(m_size) - m_size
        h_at = len(w_ids) + len(m_ids) + np.cumsum(h_n) - h_n
        at = np.concatenate([np.stack([w_at[a], m_at[b]], 1).ravel() if len(a) else np.zeros(0, np.int64), h_at])
        n = np.concatenate([np.stack([w_n[a], m_size[b]], 1).ravel() if len(a) else np.zeros(0, np.int64), h_n])
        got = pool[taken(at, n)]
        size = np.concatenate([w_n[a] + m_size[b], h_n])
        self.known = pa.concat_arrays([self.known, easy, rest])
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, got])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with its end id, and how many each has."""
        if self.words is None:
            rows = [[*x, self.end] for x in self.encoded(texts.to_pylist())]
            n = np.array([len(x) for x in rows], np.int64)
            return np.fromiter((i for x in rows for i in x), np.int32, int(n.sum())), n
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        names = chunks.dictionary
        if len(self.known) + len(names) > self.keep:
            self.clear()
        number = pc.index_in(names, value_set=self.known)
        new = names.filter(number.is_null())
        if len(new):
            self.learn(new)
            number = pc.index_in(names, value_set=self.known)
        found = 1 + number.to_numpy().astype(np.int64)[chunks.indices.to_numpy()]
        of = pc.list_value_length(lists).to_numpy().astype(np.int64)
        found = np.insert(found, np.cumsum(of), 0)
        n = self.size[found]
        ids = self.ids[taken(self.begin[found], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(of + 1)
        return ids, np.diff(upto[ends], prepend=0)


def taken(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places begin[i] to begin[i] + n[i] of all i, one after the other."""
    total = int(n.sum())
    out = np.ones(total, np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    b, m = begin[some], n[some]
    head = np.cumsum(m) - m
    out[head] = np.diff(b, prepend=0) - np.concatenate([[0], m[:-1] - 1])
    return np.cumsum(out)


FRAME = "shard int, frame int, doc_ids array<bigint>, sizes array<int>"
#: A worker keeps its encoder, and with it the chunks it knows, from task to task.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def gathered(batches, least: int = 1 << 23):
    """Batches put together until they have so many bytes: equal chunks of one are looked up once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _writer(path: str, end: int, frame_ids: int):
    def run(batches):
        from pyspark import TaskContext

        shard, frame = TaskContext.get().partitionId(), 0
        enc = _ENCODERS.setdefault((path, end), Encoder(path, end))
        docs, sizes, parts, total = [], [], [], 0

        def flush():
            nonlocal docs, sizes, parts, total, frame
            raw = np.concatenate(parts).astype("<i4").tobytes()
            b = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([frame], pa.int32()), pa.array([np.concatenate(docs).tolist()], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([raw], pa.binary())], ["shard", "frame", "doc_ids", "sizes", "raw"])
            docs, sizes, parts, total, frame = [], [], [], 0, frame + 1
            return b

        for b in gathered(batches):
            ids, n = enc(pc.fill_null(b.column(1), ""))
            docs.append(np.array(b.column(0).to_pylist(), object))
            sizes.append(n)
            parts.append(ids)
            total += len(ids)
            if total >= frame_ids:
                yield flush()
        if docs:
            yield flush()

    return run


def coder(spark: SparkSession) -> None:
    java_functions(spark, "TokenCoder.java", {"token_pack": ("Pack", "binary"), "token_unpack": ("Unpack", "binary"), "token_checksums": ("Checksums", "array<bigint>"), "token_starts": ("Starts", "array<bigint>")})


def write_tokens(docs: DataFrame, path: str, end: int = 1, vocabulary: str = "", frame_ids: int = 1 << 20) -> None:
    """Writes the token files of docs (doc_id, text) to `path`, in ascending doc_id order over shards and frames. A frame
    ends with the lot of documents that reaches frame_ids."""
    small_batches(docs.sparkSession)
    coder(docs.sparkSession)
    # A random number spreads equal rows over shards; whichever comes first, the files are the same.
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.rand(7).alias("spread"))
    d = d.repartitionByRange("doc_id", "tie", "spread").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    frames = d.mapInArrow(_writer(vocabulary or public_tokenizers.path(VOCABULARY), end, frame_ids), f"{FRAME}, raw binary")
    frames.select("shard", "frame", "doc_ids", "sizes", F.call_function("token_pack", "raw").alias("payload")).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at `path`, decoded and checked. The ids themselves
    are token_unpack(payload), a frame's documents one after the other, little-endian 32-bit integers."""
    coder(spark)
    frames = spark.read.schema(f"{FRAME}, payload binary").parquet(path)
    crc = F.call_function("token_checksums", "payload", "sizes").alias("crc")
    frames = stored(frames.select("shard", "frame", "doc_ids", "sizes", crc, F.call_function("token_starts", "sizes").alias("starts")), "tokens-read")
    # Ids before a frame: of earlier shards, and of earlier frames in its shard. One row a shard goes through one window.
    sizes = frames.select("shard", "frame", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(W.orderBy("shard")) - F.col("all"))
    base = sizes.withColumn("inner", F.sum("n").over(W.partitionBy("shard").orderBy("frame")) - F.col("n")).join(shards, "shard").select("shard", "frame", (F.col("before") + F.col("inner")).alias("base"))
    rows = frames.join(base, ["shard", "frame"]).select("base", F.inline(F.arrays_zip("doc_ids", "sizes", "crc", "starts")))
    return rows.select(F.col("doc_ids").alias("doc_id"), (F.col("base") + F.col("starts")).alias("start"), F.col("sizes").cast("bigint").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid4().hex}"
    on_exit_deleted(spark, path)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
