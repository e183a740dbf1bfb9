"""Token counts of fields and sections by offset mapping.

A document's fields are laid out as one text, encoded once as a whole. Byte-level tokens spell the text's bytes, so
token lengths give each token's byte span. Sections (each field, the last one line by line; a line's end belongs to the
line) are byte intervals too; the two sorted lists of intervals are joined, and a token that crosses a boundary goes to
the section that holds most of its bytes, to the earlier of equals. So each token counts once, and a document's counts
add up to the number of its tokens.

Defined cases: a null field is empty; an empty section has 0 tokens; very long texts are encoded whole, in time that grows
with their length, and texts of many short lines give a row for each; repeated rows each give their own sections (the
query tells them apart by nothing but their content); extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(4)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer in a ranks file, and the number of bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lens = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lens[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lens


def allocate(lens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Tokens per section; lens: bytes of each token in order, edges: byte ends of the sections in order."""
    ends = np.cumsum(lens)
    first, last = np.searchsorted(edges, ends - lens, "right"), np.searchsorted(edges, ends - 1, "right")
    cross = np.flatnonzero(first != last)
    if len(cross):
        # Every section that a crossing token touches, token by token: no more than sections and tokens together.
        many = last[cross] - first[cross] + 1
        head = np.cumsum(many) - many
        token = np.repeat(cross, many)
        section = np.repeat(first[cross] - head, many) + np.arange(len(token))
        low = np.concatenate([[0], edges])[section]
        share = np.minimum(edges[section], ends[token]) - np.maximum(low, ends[token] - lens[token])
        best = np.flatnonzero(share == np.repeat(np.maximum.reduceat(share, head), many))
        _, at = np.unique(token[best], return_index=True)  # the earliest of equals
        first[cross] = section[best[at]]
    return np.bincount(first, minlength=len(edges))


def sections_of(fields: list[str | None]) -> tuple[str, list[tuple[int, int, int]]]:
    """The document as one text, and (field, section in it, bytes) of each section."""
    heads = [(f or "") + "\n" for f in fields[:-1]]
    lines = (fields[-1] or "").split("\n")
    lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
    out = [(i, 0, len(h.encode())) for i, h in enumerate(heads)] + [(len(heads), i, len(x.encode())) for i, x in enumerate(lines)]
    return "".join(heads + lines), out


def _counter(path: str, names: tuple[str, ...]):
    def run(batches):
        enc, lens = encoding(path)
        for b in batches:
            rows = {k: [] for k in ("at", "field", "section", "n")}
            for at, fields in enumerate(zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)):
                text, parts = sections_of(list(fields))
                ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
                n = allocate(lens[ids], np.cumsum([x[2] for x in parts]))
                rows["at"] += [at] * len(parts)
                rows["field"] += [names[x[0]] for x in parts]
                rows["section"] += [x[1] for x in parts]
                rows["n"] += n.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows["at"], pa.int64())), pa.array(rows["field"], pa.string()), pa.array(rows["section"], pa.int32()), pa.array(rows["n"], pa.int64())], ["doc_id", "field", "section", "n_tokens"])

    return run


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), vocabulary: str = "") -> DataFrame:
    """doc_id, field, section, n_tokens for each section of each row."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    columns = [F.col(f).cast("string").alias(f"field {i}") for i, f in enumerate(fields)]
    return docs.select("doc_id", *columns).mapInArrow(_counter(path, fields), f"doc_id {dict(docs.dtypes)['doc_id']}, field string, section int, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
