"""Hard negatives, language identification and alignment against brute force, and on odd tables."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notaflow.llm import alignment, langid, mining

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "chunk string, `of` string, number string, bucket string, score string, label string, h string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, *"abcdefg") for i, t, lang in rows], f"{DOC}, {EXTRA}")


# ---- hard negatives


def plain_negatives(rows, every=50, scale=256, positives=5, negatives=3):
    good = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    usual = min(((-n, d) for d, n in collections.Counter(len(v) for *_, v in good).items()), default=(0, 0))[1]
    good = [g for g in good if len(g[2]) == usual]
    out, seen = [], set()
    for a, label, x in good:
        if a % every or (a, label, tuple(x)) in seen:
            continue
        seen.add((a, label, tuple(x)))
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, other, y in good if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


SCHEMA = "vec_id bigint, embedding array<double>, label int, part int, key string, nth int"


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mining.hard_negatives(df, **more).collect())


@pytest.mark.parametrize("width,block", [(2, 64), (3, 8192)])
def test_hard_negatives_against_brute_force(spark, width, block):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) / 3).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, [0.3] * 8, i % 2) for i in range(90)]  # a hot vector: ties
    rows += [rows[0], rows[50], rows[77], (100, [-0.2] * 8, 1), (150, rows[150][1], 2)]  # repeated, and one id with more vectors or labels
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.1] * 7 + [None], 1), (2003, [0.1] * 7 + [float("nan")], 1), (2004, [0.1] * 7 + [float("inf")], 1), (2005, [0.1] * 8, None), (None, [0.1] * 8, 1), (2006, [0.1] * 5, 1), (2050, [0.0] * 8, 1)]
    assert mined(spark, rows, width=width, block_rows=block, chunk_rows=8, sample_rows=128) == plain_negatives(rows)


def test_hard_negatives_of_few_and_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == [] == mined(spark, [(50, [1.0], 0)])
    few = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.6, 0.0], 1), (3, [0.96, 0.0], 1)]
    assert mined(spark, few) == plain_negatives(few) == [(0, 1, 1, 2, 65536, 256 * 153)]


def test_huge_components_take_part(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1e30, 1.0], 0), (2, [2e15, 0.0], 1), (3, [1e14, 3.0], 0), (4, [0.7e14, 0.0], 1), (5, [6e13, 1.0], 1)]
    got = mined(spark, rows)
    assert [g for g in got if g[1] != 1] == [g for g in plain_negatives(rows) if g[1] != 1] != []
    assert {g[4] for g in got if g[1] == 1} <= {2**63 - 2**10}


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(3000, 13)) / 3)
    books = mining.Codebooks(x[:1000], 2, 6, 1)
    low, high = books.bounds(x[:40], *books.encode(x))
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.mean(high - low) < 0.25 * np.ptp(exact)
    kth = np.sort(exact, 1)[:, -5]
    assert np.mean(high >= kth[:, None]) < 0.1


# ---- language


def test_language_on_the_table(spark):
    got = langid.op12_language(spark, FOLDER).toPandas()
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet'").df()
    both = docs.merge(got, on="doc_id")
    assert len(both) == len(docs) == len(got) and got.score.between(0, 1).all()
    import zlib

    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    away = both[both.held_out & (both.lang_pred != "und")]
    assert (away.lang == away.lang_pred).mean() >= 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = (langid.identify(docs, langid.fit(d)).orderBy("doc_id").collect() for d in (docs, other))
    assert a == b


def test_language_on_odd_rows(spark):
    rng = random.Random(2)
    made = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, made("abcdef", 30) if i % 3 else made("uvwxyz", 30), "aa" if i % 3 else "uu") for i in range(120)]
    odd = [(500, None, "aa"), (501, "", "aa"), (502, " 12 .. \n", None), (503, made("uvwxyz", 200_000), "uu"), (504, "a", "aa"), (505, "ZYXW " * 9, None), (505, "ZYXW " * 9, None), (None, made("abcdef", 9), "uu"), (506, "\U0001f600 zyx ퟿", None)]
    docs = documents(spark, rows + odd)
    got = collections.defaultdict(list)
    for r in langid.identify(docs, langid.fit(docs)).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[500] == got[501] == got[502] == [("und", 0.0)]
    assert [x for x, _ in got[503]] == ["uu"] and len(got[505]) == 2 and {x for x, _ in got[505]} == {"uu"}
    assert got[None][0][0] == "aa" and all(0 <= s <= 1 for v in got.values() for _, s in v)
    none = documents(spark, [])
    assert langid.identify(none, langid.fit(none)).collect() == []
    unlabelled = documents(spark, [(1, "text", None)])
    assert [tuple(r) for r in langid.identify(unlabelled, langid.fit(unlabelled)).collect()] == [(1, "und", 0.0)]


def test_frequencies_and_buckets_against_plain_counting(spark):
    texts = ["Ab c", "ab ab", None, "12", "ça va?", "ab " * 300_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = {r.bucket: r.n for r in df.mapInArrow(langid._frequencies(16), "bucket int, n bigint").collect()}
    want = collections.Counter()
    for t in texts:
        c = langid.normalized(t)
        want.update({int(x) for b in langid.grams(c, 16) for x in b})
    assert got.pop(-1) == 4 and got == dict(want)
    words = "".join(map(chr, langid.normalized("  Ça--va 3 bien!")))
    assert words == " ça va bien "
    grams = [words[i : i + n] for n in (1, 2, 3, 4) for i in range(len(words) - n + 1) if words[i : i + n] != " "]
    (buckets,) = langid.grams(langid.normalized(words), 16)
    assert len(buckets) == len(grams) and len({*zip(grams, buckets.tolist(), strict=True)}) == len(set(grams))


def test_leader_against_plain_steps():
    """The update of one coordinate, by its formulas."""
    leader = langid.Leader(1, 1, rate=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = 0.0
    for g in (0.4, -1.2, 0.05, 2.0):
        w = 0.0 if abs(z) <= 0.1 else -(z - np.sign(z) * 0.1) / ((1 + n**0.5) / 0.5 + 0.2)
        assert leader.weights()[0, 0] == pytest.approx(w)
        leader.learn(np.array([0]), np.array([[w]]), np.array([[g]]))
        z, n = z + g - ((n + g * g) ** 0.5 - n**0.5) / 0.5 * w, n + g * g


def test_temperature_fits_probabilities():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(5000, 3)) * 2
    p = langid.softmax(s)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert langid.temperature(s * 4, y) == pytest.approx(4, rel=0.1)


# ---- alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spell = {i: bytes(alignment.byte_of()[c] for c in t) for t, i in a.get_vocab().items() if not t.startswith("<|")}
    piece = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, spell, piece


def plain_alignment(both, texts):
    tok_a, tok_b, spell, piece = both
    docs = []
    for text in texts:
        a = b = groups = []
        if text:
            x, y = tok_a.encode(" " + text, add_special_tokens=False).ids, tok_b.encode(text)
            if b"".join(map(spell.get, x)) == (" " + text).encode() == b"".join(map(piece.__getitem__, y)):
                a, b, groups, at, j, left, right = x, y, [], [0, 0], 0, [], []
                for i in a:
                    left.append(i)
                    at[0] += len(spell[i])
                    while at[1] < at[0]:
                        right.append(b[j])
                        at[1] += len(piece[b[j]])
                        j += 1
                    if at[0] == at[1]:
                        groups.append((left, right))
                        left, right = [], []
        docs.append((a, b, groups))
    links = [[(p, q) for x, y in g for p in x for q in y] for *_, g in docs]
    count = collections.Counter(pair for x in links for pair in set(x))
    best = collections.Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (a, b, g), x in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((len(a), len(b), len(g), len(x), sum(count[k] == best[k[0]] for k in x), sum(count[k] for k in x), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_alignment_on_the_table(spark, both):
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op13_alignment(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in docs], plain_alignment(both, [r.text for r in docs]), strict=True))


def test_alignment_on_odd_rows(spark, both, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "one", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語のテキスト 🎉🎉 naïve", "x" * 30_000, "a▁b", "tab\tend  two  ", "é", "\x00\x01",
             "".join(rng.choice("語学日本のテ") for _ in range(3000)), " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(20_000)), "one", "one two", "one"]
    docs = documents(spark, [(None if i == 16 else 7 if i in (14, 15) else i, t, None) for i, t in enumerate(texts)])
    for chunk in (alignment.CHUNK, 100):
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in alignment.align(docs).collect())
        ids = [str(r.doc_id) for r in docs.select("doc_id").collect()]
        assert got == sorted((i, *w) for i, w in zip(ids, plain_alignment(both, texts), strict=True))
    assert alignment.align(documents(spark, [])).collect() == []


def test_tokenizers_agree_with_their_libraries(both):
    """A's ids by ranks are those of the tokenizer file, on texts with all kinds of white space, signs and scripts."""
    v = alignment.vocabularies(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    rng = random.Random(6)
    signs = "ab Z9'sdllverem\t\n\r\x0b\x0c\xa0 　​-_.,<|>🎉éßñ語ا̀ "
    texts = ["".join(rng.choice(signs) for _ in range(200)) for _ in range(300)]
    want = [e.ids for e in both[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [v.a.encode(" " + t, disallowed_special=()) for t in texts] == want


def test_groups_with_surplus_against_counting():
    v = alignment.vocabularies(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    texts = ["tokenization tokenizations retokenization of tokens", "tokens of retokenization", "of of of", "", "unbelievably believable unbelief"]
    g = alignment.Groups(v, *v.encode(texts))
    doc, number, _ = alignment.distinct(g.doc, g.number, len(g.at))
    pairs, more = alignment.surplus(g, doc, number)
    held = collections.defaultdict(set)
    for d, k in zip(doc.tolist(), number.tolist(), strict=True):
        a, b = g.ids(g.at[k])
        held[d].update((k, p, q) for p in a.tolist() for q in b.tolist())
    want = collections.Counter()
    for x in held.values():
        for (p, q), n in collections.Counter((p, q) for _, p, q in x).items():
            want[p << 32 | q] += n - 1
    assert dict(zip(pairs.tolist(), more.tolist(), strict=True)) == {k: n for k, n in want.items() if n}
