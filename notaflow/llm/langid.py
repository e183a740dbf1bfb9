"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, every run of anything but letters becomes one space, and the n-grams of one to four characters of
what results (a space before and after it) are hashed into 2^bits buckets. A bucket's value is its share of the text's
n-grams times its inverse document frequency. Frequencies are counted over all learnable documents. Weights are trained by
follow-the-regularised-leader (per coordinate, L1 and L2 penalties, in small batches) on a sample of about `sample_docs`
documents, the same number of each language, chosen by a hash; a fifth of the sample is kept back, and on it one
temperature is fitted that makes the probabilities fit. Most weights are exactly zero.

Learnable are documents with doc_id, language and a letter in the text whose crc32(doc_id as text) mod 4 is not 2. Only the text is
an input of a prediction.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text where nothing is learnable; rows
without doc_id are predicted, not learned from and not held out; repeated rows each give a row and count each in the
frequencies; a very long text is predicted and counted whole, in pieces, but trains only if it has at most `sample_chars`
characters; ties between languages go to the first by code point; extra columns are ignored; no rows give no rows. The
model has (languages x buckets) numbers at most, and the driver holds those and the sample.
"""

from __future__ import annotations

from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: n-grams of so many characters.
LONGEST = 4
#: Code points whose n-grams are worked on at a time.
PIECE = 1 << 18
#: A text's values add up to this times its mean inverse document frequency.
SCALE = 64.0
SPACE = 32


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([category(chr(i))[0] == "L" for i in range(0x110000)])


def normalized(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters with single spaces between, before and after; none without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    c = np.concatenate([[SPACE], np.where(is_letter, c, SPACE), [SPACE]]).astype(np.uint32)
    keep = c != SPACE
    keep[1:] |= c[:-1] != SPACE
    keep[0] = True
    return c[keep]


def grams(c: np.ndarray, bits: int):
    """Buckets of the n-grams that start in each piece of a normalized text."""
    for at in range(0, len(c), PIECE):
        part = c[at : at + PIECE + LONGEST - 1]
        one = part * np.uint32(0x9E3779B1)
        one ^= one >> np.uint32(15)
        rolled, out = one, []
        for n in range(1, LONGEST + 1):
            if n > 1:
                rolled = rolled[:-1] * np.uint32(0x85EBCA6B) + one[n - 1 :]
            mixed = (rolled ^ (rolled >> np.uint32(13))) * np.uint32((0xC2B2AE35 + 2 * n) & 0xFFFFFFFF)
            out.append((mixed[:PIECE] >> np.uint32(32 - bits)).astype(np.int64))
        out[0] = out[0][part[: len(out[0])] != SPACE]
        yield np.concatenate(out)


def together(c: list[np.ndarray], bits: int):
    """(text number, buckets) of many short texts at once, or of one long one piece by piece."""
    group: list[int] = []
    size = 0
    for i, x in enumerate(c):
        if len(x) > PIECE:
            for b in grams(x, bits):
                yield np.full(len(b), i), b
            continue
        group.append(i)
        size += len(x)
        if size > PIECE or i == len(c) - 1:
            yield _joined(c, group, bits)
            group, size = [], 0
    if group:
        yield _joined(c, group, bits)


def _joined(c: list[np.ndarray], group: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    per = [np.concatenate([*grams(c[i], bits), np.zeros(0, np.int64)]) for i in group]
    return np.repeat(group, [len(x) for x in per]), np.concatenate(per)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(bits: int):
    """How many texts of the task hold each bucket, and the number of texts with letters as bucket -1."""

    def run(batches):
        df, first, texts = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for c in map(normalized, batch.column(0).to_pylist()):
                texts += len(c) > 0
                if len(c) > PIECE // 4:
                    met = np.zeros(1 << bits, bool)
                    for b in grams(c, bits):
                        met[b] = True
                    df += met
                else:
                    for b in grams(c, bits):  # one piece
                        order = np.arange(len(b))
                        first[b] = order  # the last of equal buckets stays
                        df[b[first[b] == order]] += 1
        at = np.flatnonzero(df)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], texts), pa.int64())], ["bucket", "n"])

    return run


def _examples(bits: int):
    def run(batches):
        for batch in batches:
            keep, buckets, counts = [], [], []
            for i, c in enumerate(map(normalized, batch.column(2).to_pylist())):
                if len(c):
                    b, n = np.unique(np.concatenate(list(grams(c, bits))), return_counts=True)
                    keep.append(i)
                    buckets.append(b.astype(np.int32))
                    counts.append(n.astype(np.int32))
            if keep:
                ends = pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v))) for v in (buckets, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), *lists], ["lang", "h", "buckets", "counts"])

    return run


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader, per coordinate: weights (features, classes) with elastic-net penalties."""

    def __init__(self, features: int, classes: int, rate: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1e-3):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.rate + self.l2))

    def learn(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at] + gradient**2
        self.z[at] += gradient - (np.sqrt(n) - np.sqrt(self.n[at])) / self.rate * w
        self.n[at] = n


def rows_of(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the chosen rows, and which of them each belongs to."""
    n = ends[which + 1] - ends[which]
    of = np.repeat(np.arange(len(which)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ends[which][of], of


def logits(w: np.ndarray, features: np.ndarray, values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(of, values * w[features, c], rows) for c in range(w.shape[1])], 1)


def train(y: np.ndarray, ends: np.ndarray, features: np.ndarray, values: np.ndarray, size: int, classes: int, rounds: int = 3, batch: int = 32, seed: int = 12) -> np.ndarray:
    """Weights (size, classes); rows ends[i]..ends[i + 1] of features and values are text i."""
    leader, draw = Leader(size, classes), np.random.default_rng(seed)
    for _ in range(rounds):
        order = draw.permutation(len(y))
        for i in range(0, len(order), batch):
            which = order[i : i + batch]
            at, of = rows_of(ends, which)
            met, inner = np.unique(features[at], return_inverse=True)
            w = leader.weights(met)
            off = softmax(logits(w, inner, values[at], of, len(which)))
            off[np.arange(len(which)), y[which]] -= 1
            leader.learn(met, w, np.stack([np.bincount(inner, off[of, c] * values[at], len(met)) for c in range(classes)], 1))
    return leader.weights()


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits s with the least log loss on labels y, by golden section on its logarithm. A label counts as
    certain as so many rows can show: (n + 1) / (n + 2) for one that n rows have."""
    if not len(y):
        return 1.0
    sure = (np.bincount(y) + 1)[y] / (np.bincount(y) + 2)[y]

    def loss(t: float) -> float:
        p = softmax(s / np.exp(t))[np.arange(len(y)), y]
        return -np.mean(sure * np.log(np.maximum(p, 1e-300)) + (1 - sure) * np.log(np.maximum(1 - p, 1e-300)))

    low, high, cut = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, sample_docs: int = 4000, sample_chars: int = 20_000, bits: int = 16) -> dict | None:
    """names: languages by code point; table (languages, buckets): weight times inverse document frequency; bias; temperature."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out())
    df = known.select("text").mapInArrow(_frequencies(bits), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = df.column("bucket").to_numpy(), df.column("n").to_numpy()
    if not len(bucket):
        return None
    idf = np.zeros(1 << bits)
    idf[bucket[bucket >= 0]] = np.log((1 + n[bucket < 0][0]) / (1 + n[bucket >= 0])) + 1
    short = known.where((F.char_length("text") <= sample_chars) & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in short.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per = max(20, sample_docs // len(sizes))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per / n))]), F.col("lang")), F.lit(0.0))
    rows = short.select("lang", h.alias("h"), "text").where(F.col("h") < quota).mapInArrow(_examples(bits), "lang string, h double, buckets array<int>, counts array<int>").orderBy("h", "lang").toArrow()
    if not rows.num_rows:
        return None
    names, y = np.unique(np.array(rows.column("lang").to_pylist(), object), return_inverse=True)
    lists = rows.column("buckets").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    features, counts = lists.flatten().to_numpy().astype(np.int64), rows.column("counts").combine_chunks().flatten().to_numpy()
    of = np.repeat(np.arange(len(y)), np.diff(ends))
    values = SCALE * counts / np.bincount(of, counts)[of] * idf[features]
    # The bias is one more feature, of value 1.
    features, values, of = np.append(features, np.full(len(y), 1 << bits)), np.append(values, np.ones(len(y))), np.append(of, np.arange(len(y)))
    order = np.argsort(of, kind="stable")
    features, values, ends = features[order], values[order], ends + np.arange(len(ends))
    back = np.arange(len(y)) % 5 == 4
    w = train(y[~back], *_rows(ends, features, values, np.flatnonzero(~back)), (1 << bits) + 1, len(names))
    ends_back, f, v = _rows(ends, features, values, np.flatnonzero(back))
    at = np.repeat(np.arange(back.sum()), np.diff(ends_back))
    t = temperature(logits(w, f, v, at, int(back.sum())), y[back])
    return {"names": names.tolist(), "table": np.ascontiguousarray((w[:-1] * SCALE * idf[:, None]).T), "bias": w[-1], "temperature": t, "bits": bits}


def _rows(ends: np.ndarray, features: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, of = rows_of(ends, which)
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(which)))]), features[at], values[at]


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    c = [normalized(x) for x in texts] if model else []
    seen = np.array([len(x) > 0 for x in c], bool) if model else np.zeros(len(texts), bool)
    if not seen.any():
        return ["und"] * len(texts), np.zeros(len(texts))
    sums, total = np.zeros((len(c), len(model["names"]))), np.zeros(len(c))
    for of, b in together(c, model["bits"]):
        total += np.bincount(of, minlength=len(c))
        for k, weights in enumerate(model["table"]):
            sums[:, k] += np.bincount(of, weights[b], len(c))
    p = softmax((sums / np.maximum(total, 1)[:, None] + model["bias"]) / model["temperature"])
    best = p.argmax(1)
    return [model["names"][k] if s else "und" for k, s in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, p[np.arange(len(c)), best], 0.0)


def predictor(model: dict | None):
    def run(batches):
        for b in batches:
            names, score = predict(model, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*keep, F.col("text").alias("text to read")).mapInArrow(predictor(model), schema)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
