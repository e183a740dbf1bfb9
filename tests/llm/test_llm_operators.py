"""The training-data operators against brute force, and on odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notaflow.llm import ann, attribution, extraction, jaccard, mixing, pii, quality, segmentation, tokenfile, topk
from notaflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows and ids, and columns that clash with the operators' own."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (5, long, "en", "b"), (6, "x" * 50_000, "en", "b"), (7, "héllo wörld 日本 🎉 a@b.co", "en", "b"), (7, "héllo wörld 日本 🎉 a@b.co", "en", "b"), (8, long, "en", "c"), (None, "no id here at all", "en", "a")]
    df = spark.createDataFrame([(*r[:2], *r[2:], 0, "k", 9, 1.5) for r in rows], DOC + ", size string, taken bigint, score double")
    return df.withColumns({"cls": F.lit("c"), "base": F.lit(1), "shard": F.lit(None).cast("string"), "block": F.lit(2), "label": F.lit(0)})


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)


# ---- vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, block int, chunk string")


def brute(rows, k, every, make):
    good = [(i, make(np.array(v, np.float64))) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            scores = sorted(((-float(x @ y), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.fixture(scope="session")
def points():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    same = [0.25] * 8
    rows += [(1000 + i, same) for i in range(90)]  # a hot vector: ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7 + [None]), (2003, [1.0] * 7 + [float("nan")]), (2004, [1.0] * 7 + [float("inf")]), (2005, [0.0] * 8), (None, same), (2006, [1.0] * 5)]
    return rows


def test_repeated_query_rows(spark, points):
    few = [p for p in points if p[0] is not None and p[0] < 200]
    other = [-x for x in few[40][1]]
    rows = [(*p, 7, "x") for p in [*few, few[0], few[0], (40, other)]]
    exact = topk.histogram_topk(vectors(spark, rows), 20, 20, 64.0, 16, 64, 4)
    for df in (exact, ann.projected_search(vectors(spark, rows), 20, 20, confidence=1 - 1e-12)):
        got = collections.defaultdict(list)
        for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.rank, r.vec_id))
        assert [n for n, _ in got[0]] == list(range(1, 21))
        assert len({i for _, i in got[0]}) == 20
        assert [n for n, _ in got[40]] == [n for n in range(1, 21) for _ in range(2)]
        assert len({i for _, i in got[40]}) > 20
    want = brute(few, 20, 20, lambda v: np.floor(64 * v))
    assert [r.vec_id for r in sorted(exact.where("query_id = 0").collect(), key=lambda r: r.rank)] == [i for i, _ in want[0]]


def test_topk(spark, points):
    rows = points
    for blocks in (4096, 64):
        got = collections.defaultdict(list)
        for r in sorted(topk.histogram_topk(vectors(spark, [(*p, 7, "x") for p in rows]), 20, 20, 64.0, 16, blocks, 16).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.vec_id, r.score))
        assert got == brute(rows, 20, 20, lambda v: np.floor(64 * v))
    few = [(0, [1.0] * 8), (1, [2.0] * 8), (2, [3.0] * 8)]
    assert [(r.rank, r.vec_id) for r in sorted(topk.histogram_topk(vectors(spark, [(*p, 7, "x") for p in few])).collect(), key=lambda r: r.rank)] == [(1, 2), (2, 1)]
    assert topk.histogram_topk(vectors(spark, [])).count() == 0


def test_ann(spark, points):
    rows = [p for p in points if p[1] is None or any(x != 0 for x in p[1] if x is not None)]
    want = brute(rows, 20, 20, lambda v: v)
    got = collections.defaultdict(list)
    for r in sorted(ann.projected_search(vectors(spark, [(*p, 7, "x") for p in points]), block_rows=128, leaf=16).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    assert all(len(v) == 20 for v in got.values())
    exact = {i: np.array(v, float) for i, v in points if i is not None and v and len(v) == 8 and None not in v}
    assert all(s == pytest.approx(float(exact[q] @ exact[i]), abs=1e-12) for q, v in got.items() for i, s in v)
    assert ann.projected_search(vectors(spark, [])).count() == 0


def test_huge_finite_components(spark, points):
    """They take part: integer scores stop at 64 bits, doubles at infinity."""
    rng = np.random.default_rng(9)
    rows = [p for p in points if p[0] is not None and p[0] < 60] + [(3000 + i, (rng.normal(size=8) * 10.0 ** rng.integers(5, 38, 8)).astype(np.float32).tolist()) for i in range(60)] + [(3100, [3e38] * 8), (3101, [-3e38] * 8)]
    schema = "vec_id bigint, embedding array<double>"
    double = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = collections.defaultdict(list)
    for r in sorted(topk.histogram_topk(spark.createDataFrame(double, schema), block_rows=50).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in double}
    most = topk.MOST
    for q in whole:
        if q % 20 == 0:
            want = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:20]
            assert got[q] == [(i, -s) for s, i in want]
    wild = double + [(4000, [1e200] * 8), (4020, [-1e200, 1e200] * 4), (4021, [1e300] + [0.0] * 7)]
    found = collections.defaultdict(list)
    for r in sorted(ann.projected_search(spark.createDataFrame(wild, schema), confidence=1 - 1e-12, block_rows=40).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert all(len(v) == 20 and not np.isnan([s for _, s in v]).any() for v in found.values())
    assert found[4000][0] == (4021, np.inf) and found[0][0][0] in (4000, 4020, 4021)
    assert topk.histogram_topk(spark.createDataFrame(wild, schema)).count() == 20 * sum(i % 20 == 0 for i, _ in wild)


def test_ann_recall_and_stop_on_the_table(spark):
    """In 64 dimensions with production parameters: recall 0.9 and more, and the stopping test does stop."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    got = ann.projected_search(df).collect()
    near = collections.defaultdict(set)
    for r in got:
        near[r.query_id].add(r.vec_id)
    hits = []
    for q, v in rows:
        if q % 20 == 0:
            s = np.where(ids == q, -np.inf, x @ v)
            hits.append(len(near[q] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9
    assert np.mean([r.verified / r.of_rows for r in got]) < 0.8


def test_chi_square():
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert sorted(np.concatenate(ann.kd_leaves(np.zeros((100, 3)), 16)).tolist()) == list(range(100))


# ---- similarity join


def naive_groups(rows, words, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = frozenset(zip(*[w[j:] for j in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    name = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(name[a], name[b])
            if name[a] != m or name[b] != m:
                name[a] = name[b] = m
                changed = True
    return {i: (len(sets[i]), name[i]) for i in sets}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, words, percent):
    rng = random.Random(words)
    rows = []
    for size in (1, 2, 3, 5, 9, 12, 20, 60, 150, 400):
        base = prose(rng, size).split()
        for _ in range(12):  # near copies at all distances, and exact ones
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                t[rng.randrange(len(t))] = prose(rng, 1)
            rows.append((len(rows), " ".join(t).upper() if rng.random() < 0.2 else "  ".join(t)))
    rows += [(900, None), (901, ""), (902, "\n \t")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, cls string, n int").repartition(5)
    for block in (256, 4):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, words, percent, block=block, task_rows=10).collect()}
        assert got == naive_groups(rows, words, percent)


def test_jaccard_odd(spark, odd):
    got = jaccard.similar_groups(odd, 3, 90).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(1, 4)}
    assert by[7] == {(3, 7)} and {c for _, c in by[5] | by[8]} == {5}
    assert by[None] == {(3, None)}
    rng = random.Random(3)
    base = prose(rng, 60)
    near = base.replace(base.split()[7], "zzz", 1)
    rows = [(None, base), (None, base), (None, near), (9, near), (4, base + " end"), (None, "nothing like it at all"), (None, "nothing like it at all"), (11, base), (11, "some other text with this id")]
    got = sorted(((r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 3, 90).collect()))
    assert got == sorted([(58, 4)] * 4 + [(59, 4)] + [(3, -1)] * 2 + [(58, 4), (4, 11)])
    assert jaccard.similar_groups(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    name = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == name
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- quality


def test_crf_against_enumeration():
    rng = np.random.default_rng(2)
    s, t, n = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 1, 4])
    m, pair = quality.marginals(s, t, n)
    want, trans, at = np.zeros(9), np.zeros((2, 2)), 0
    for k in n:
        total = 0.0
        part, part_t = np.zeros(k), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(k)):
            w = np.exp(sum(s[at + i] * y[i] for i in range(k)) + sum(t[y[i], y[i + 1]] for i in range(k - 1)))
            total += w
            part += w * np.array(y)
            for i in range(k - 1):
                part_t[y[i], y[i + 1]] += w
        want[at : at + k] = part / total
        trans += part_t / total
        at += k
    assert np.allclose(m, want) and np.allclose(pair, trans)


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        lines = [prose(rng, 12).capitalize() + "." for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(" ".join(w.upper() + "!!" for w in x.split()) for x in lines) if bad else "\n".join(lines), "en", "s", 0))
        labels.append((i, 0 if bad else 1))
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.classify(docs, lab).withColumn("held", quality.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 1), (5, 1), (6, 0), (None, 1), (8, None)], "doc_id bigint, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.held for r in odd.where("doc_id IS NULL").select(quality.held_out().alias("held")).collect()} == {False}
    twice = odd.unionByName(odd.withColumn("text", F.lit("another text with this id")))
    runs = [sorted((r.doc_id or -1, r.score) for r in quality.classify(twice.repartition(n), labels).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
    assert quality.fit(odd, labels, sample_lines=5) is None
    assert quality.classify(empty(spark), labels).count() == 0


# ---- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for j, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and total % 10 == 0) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), j, m.end()))
    return sorted(out)


def test_base_spans_against_patterns():
    rng = random.Random(9)
    alphabet = ["a", "@", ".", "1", "25", "256", "4", " ", "-", "+", "(", ")", "%", "é", "4111111111111111", "a@b.c", "1.2.3.4"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 300_000 + "@" * 1000 + "1" * 300_000) == []


def test_pii(spark, odd):
    text = 'é Mr. John Smith, ssn 123-45-6789, token = "0123456789abcdef0123456789abcdef01234567" mail jo@ex.com 10.0.0.1, 4111 1111 1111 1111, +1 (555) 555-1234'
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    r = rows[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    base = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in plain_spans(text))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(r.spans.split(",")) and any(x.startswith("secret:") for x in r.spans.split(","))
    assert rows[3].spans == "" and rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(odd).count() == odd.count()
    red = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert red[7].endswith("a <EMAIL>") or red[7].endswith("<EMAIL>")
    assert red[1] is None and pii.redact(odd).columns == odd.columns
    assert pii.find_pii(empty(spark)).count() == 0


def test_em_against_a_sampled_truth():
    """Votes drawn with known reliabilities: EM finds each span's truth and tells good labelers from bad ones, by kind."""
    rng = np.random.default_rng(1)
    counts, truth = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    right = {"secret": (0.95, 0.9, 0.85, 0.6, 0.9), "local_phone": (0.6, 0.95, 0.9, 0.9, 0.6)}
    for kind, of in right.items():
        for _ in range(4000):
            y = rng.random() < (0.3 if kind == "secret" else 0.7)
            v = [0 if rng.random() < 0.3 else (1 if y else -1) * (1 if rng.random() < r else -1) for r in of]
            k = f"{kind}|{','.join(map(str, v))}|000000008"
            counts[k] += 1
            truth[k][int(y)] += 1
    post, model = pii.estimate(counts)
    assert sum(max(t) for t in truth.values()) * 0.985 <= sum(truth[k][int(post[k] >= 0.5)] for k in counts)
    assert model["share"]["secret"] == pytest.approx(0.3, abs=0.05) and model["share"]["local_phone"] == pytest.approx(0.7, abs=0.05)
    assert model["for"]["secret"][0] > model["for"]["secret"][3] and model["for"]["local_phone"][1] > model["for"]["local_phone"][0]
    only = {"local_phone|1,1,0,0,0|000000008": 159, "secret|-1,0,0,0,-1|000000008": 30}
    assert pii.final_classifier(only, pii.estimate(only)[0]) == {"local_phone|1,1,0,0,0|000000008"}
    assert pii.estimate({})[0] == {} and pii.final_classifier({}, {}) == set()


def test_added_spans_against_planted_ones(spark):
    """Spans of every kind planted among look-alikes: what EM and classifier keep, by kind and place."""
    rng = random.Random(11)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    iban = lambda ok: next(x for x in iter(lambda: f"DE{rng.randint(10, 99)} " + " ".join(f"{rng.randint(0, 9999):04d}" for _ in range(4)) + f" {rng.randint(10, 99)}", None) if pii.iban_ok(x) == ok)
    good = {
        "person": lambda: ("Contact name: ", rng.choice(["John Smith", "Maria Lopez", "Anna Berg", "Peter Braun"])),
        "national_id": lambda: ("social security ssn ", f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        "iban": lambda: ("pay to account iban: ", iban(True)),
        "local_phone": lambda: ("call this phone: ", f"({rng.randint(200, 900)}) 555-{rng.randint(1000, 9999)}"),
        "secret": lambda: ("api token = ", hexes(40)),
        "birth_date": lambda: ("Born on: ", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1930, 2005)}"),
        "handle": lambda: ("follow on twitter: ", f"@{rng.choice(['jo', 'ann', 'kim'])}_{rng.randint(1, 99)}"),
    }
    bad = {
        "national_id": lambda: ("order part ", f"{rng.randint(0, 9)}".join(["000-00-", "000"])[:11]),
        "iban": lambda: ("product serial ", iban(False)),
        "secret": lambda: ("commit md5 checksum ", "0" * 32),
        "birth_date": lambda: ("Born release order ", f"{rng.randint(40, 90)}.{rng.randint(20, 90)}.{rng.randint(3000, 9000)}"),
    }
    rows, planted = [], {}
    for i in range(600):
        kind = rng.choice(sorted(good))
        false = rng.random() < 0.4 and kind in bad
        lead, span = (bad if false else good)[kind]()
        text = f"{prose(rng, 5)}. {lead}"
        planted[i] = (kind, len(text), len(text) + len(span), not false)
        rows.append((i, text + span + ", " + prose(rng, 4)))
    got = {r.doc_id: {tuple(x.split(":")) for x in r.spans.split(",") if x} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    kept = {i: (k, str(s), str(e)) in got[i] for i, (k, s, e, _) in planted.items()}
    for kind in good:
        own = [i for i, p in planted.items() if p[0] == kind]
        assert np.mean([kept[i] for i in own if planted[i][3]]) > 0.9, kind
        false = [kept[i] for i in own if not planted[i][3]]
        assert not false or np.mean(false) < 0.1, kind


# ---- tokens


def test_token_counts(spark, odd):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(1, "a", "en", "line one\n\n\nline  two\nß日本\n"), (2, None, "en", None), (3, "x\ny", "", "<|endoftext|> z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    got = collections.defaultdict(dict)
    for r in attribution.section_tokens(docs).collect():
        got[r.doc_id][r.field, r.section] = r.n_tokens
    for i, *f in rows:
        whole, parts = attribution.sections_of(f)
        edges = np.cumsum([p[2] for p in parts])
        want = np.zeros(len(parts), int)
        chars = np.cumsum([0] + [len(c.encode()) for c in whole])
        for a, b in t.encode(whole, add_special_tokens=False).offsets if whole.isascii() else []:
            over = [max(0, min(e, chars[b]) - max(s, chars[a])) for s, e in zip(np.concatenate([[0], edges[:-1]]), edges, strict=True)]
            want[int(np.argmax(over))] += 1
        n = list(got[i].values())
        assert len(n) == len(parts) and sum(n) == len(t.encode(whole, add_special_tokens=False).ids)
        if whole.isascii():
            assert n == want.tolist()
    assert attribution.section_tokens(odd).select("doc_id").distinct().count() == 9
    assert attribution.section_tokens(empty(spark)).count() == 0


def test_token_counts_beyond_ascii():
    """Characters of several bytes, and tokens over many short lines: against one token at a time."""
    rng = random.Random(2)
    enc, lens = attribution.encoding(public_tokenizers.path(attribution.VOCABULARY))
    for _ in range(300):
        fields = ["".join(rng.choice(["a", " b", "ß", "日", "🎉", "\n", "\n\n\n", "  "]) for _ in range(rng.randint(0, 20))) for _ in range(3)]
        whole, parts = attribution.sections_of(fields)
        edges = np.cumsum([p[2] for p in parts])
        low = np.concatenate([[0], edges[:-1]])
        ids = enc.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
        want, at = np.zeros(len(parts), int), 0
        for n in lens[ids].tolist():
            want[int(np.argmax([max(0, min(e, at + n) - max(s, at)) for s, e in zip(low, edges, strict=True)]))] += 1
            at += n
        assert attribution.allocate(lens[ids], edges).tolist() == want.tolist()
    import time

    began = time.process_time()
    n = 1_000_000
    assert attribution.allocate(np.full(n // 2, 2), np.arange(1, n + 1)).sum() == n // 2
    assert time.process_time() - began < 10


def test_crossing_tokens_go_to_the_larger_part():
    assert attribution.allocate(np.array([4, 4]), np.array([5, 8])).tolist() == [1, 1]
    assert attribution.allocate(np.array([4, 4]), np.array([6, 8])).tolist() == [2, 0]
    assert attribution.allocate(np.array([3, 9]), np.array([3, 3, 12])).tolist() == [1, 0, 1]


def test_token_file(spark, odd, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenfile.write_tokens(odd.repartition(3), f"file://{tmp_path}/t", frame_ids=2000)
    got = sorted(tokenfile.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    docs = odd.select("doc_id", "text").collect()
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs}
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(r.doc_id if r.doc_id is not None else -1 for r in docs)
    at = 0
    for r in got:
        raw = np.array(ids[r.doc_id], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(raw))
        at += r.n_tokens
    tokenfile.write_tokens(empty(spark), f"file://{tmp_path}/e")
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


class PlainReader:
    """One block of a token file, read by the format's description alone."""

    def __init__(self, bits, data):
        self.bits, self.data, self.at, self.range, self.code = bits, data, 5, 2**32 - 1, int.from_bytes(data[1:5], "big")
        self.tree, self.one, self.two = {}, {}, {}
        self.by = [collections.defaultdict(lambda: 32768) for _ in range(3)]
        self.weights = [[24000] * 3 for _ in range(4)]
        self.last = self.before = self.past = 0
        self.squash = [max(1, min(4095, int(4096 / (1 + np.exp(-x / 256)) + 0.5))) for x in range(-2048, 2048)]
        self.stretch = [next((x - 2048 for x in range(4096) if self.squash[x] >= p), 2047) for p in range(4096)]

    def decide(self, p):
        part = (self.range >> 16) * p
        bit = int(self.code < part)
        self.range, self.code = (part, self.code) if bit else (self.range - part, self.code - part)
        while self.range < 2**24:
            self.range, self.code = self.range << 8, (self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0))
            self.at += 1
        return bit

    def flag(self, w, keys):
        s = [self.stretch[b[k] >> 4] for b, k in zip(self.by, keys, strict=True)]
        p = self.squash[max(-2048, min(2047, sum(x * y for x, y in zip(self.weights[w], s, strict=True)) >> 16)) + 2048]
        bit = self.decide(max(64, min(65472, p << 4)))
        off = ((bit << 12) - p) * 6
        self.weights[w] = [max(0, min(200000, x + ((y * off + 8192) >> 14))) for x, y in zip(self.weights[w], s, strict=True)]
        for b, k, speed in zip(self.by, keys, (6, 6, 5), strict=True):
            b[k] = b[k] + ((65535 - b[k]) >> speed) if bit else b[k] - (b[k] >> speed)
        return bit

    def id(self):
        i1, i2 = (self.last * 0x9E3779B1 & 0xFFFFFFFF) >> 17, (self.last * 0x9E3779B1 + self.before * 0x85EBCA6B & 0xFFFFFFFF) >> 15
        (p1, c1), (p2, c2) = self.one.get(i1, (0, 0)), self.two.get(i2, (0, 0))
        same, event = int(c1 > 0 and c2 > 0 and p1 == p2), 0
        if c2 and self.flag(same, (c2 << 3 | c1, self.past & 255, c1 << 1 | same)):
            event, x = 2, p2
        elif c1 and not same and self.flag(2 + (c2 > 0), (256 | c2 << 3 | c1, 256 | self.past & 255, 32 | c1 << 1)):
            event, x = 1, p1
        else:
            node = 1
            for _ in range(self.bits):
                p = self.tree.get(node, 32768)
                bit = self.decide(max(64, min(65472, p)))
                self.tree[node] = p + ((65535 - p) >> 5) if bit else p - (p >> 5)
                node = node << 1 | bit
            x = node - (1 << self.bits)
        for table, i, (p, c) in ((self.one, i1, (p1, c1)), (self.two, i2, (p2, c2))):
            table[i] = (p, min(7, c + 1)) if c and p == x else (p, c >> 1) if c > 1 else (x, 1)
        self.before, self.last, self.past = self.last, x, self.past << 2 | event
        return x


def plainly_read(payload):
    assert payload[:4] == b"TF2\n"
    bits, count, *heads = np.frombuffer(payload, "<u4", 2 + 3 * int.from_bytes(payload[8:12], "little"), 4).tolist()
    at, out = 12 + 12 * count, []
    for n, size, crc in zip(heads[::3], heads[1::3], heads[2::3], strict=True):
        r = PlainReader(bits, payload[at : at + size])
        ids = [r.id() for _ in range(n)]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == crc
        at, out = at + size, out + ids
    assert at == len(payload)
    return out


def test_coder_round_trip_and_damage(spark):
    tokenfile.coder(spark)
    rng = np.random.default_rng(0)
    again = np.tile(rng.integers(0, 49408, 50), 100)
    rows = [np.minimum(rng.zipf(1.2, n), 49407) for n in (0, 1, 5, 700, 3000)] + [again, np.arange(70_000) * 200, np.zeros(10), np.repeat([7, 65535, 0], 400)]
    raw = [np.asarray(x).astype("<u4").tobytes() for x in rows]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, raw binary").repartition(3)
    df = df.withColumn("payload", F.call_function("token_pack", "raw"))
    got = {r.i: r for r in df.withColumn("back", F.call_function("token_unpack", "payload")).collect()}
    for i, x in enumerate(raw):
        assert bytes(got[i].back) == x
        if len(x) <= 4 * 5000:
            assert plainly_read(bytes(got[i].payload)) == np.frombuffer(x, "<u4").tolist()
    assert len(got[5].payload) < 2 * len(again) / 4
    for at, error in ((-5, "checksum differs"), (0, "not a token frame")):
        bad = bytearray(got[4].payload)
        bad[at] ^= 255
        with pytest.raises(Exception, match=error):
            spark.createDataFrame([(bad,)], "p binary").select(F.call_function("token_unpack", "p")).collect()
    for raw in (np.array([-1], "<i4"), np.array([1 << 24], "<i4")):
        with pytest.raises(Exception, match="ids"):
            spark.createDataFrame([(bytearray(raw.tobytes()),)], "p binary").select(F.call_function("token_pack", "p")).collect()


def test_chunks_are_encoded_as_whole_texts():
    """Letters, marks, blanks and odd characters in any order: chunk by chunk as in one go, for this and for another tokenizer."""
    rng = random.Random(6)
    bits = ["a", "Ab", "é", "É", "ß", "İ", "ŉ", "Σας", "日本", "'s", "'", "'ll", " ", "  ", "\n", "\t", "\u00a0", "\u0301", ".", ",,", "…", "-", "1", "23", "<", "<|endoftext|>", "|>", "x" * 400, "🎉", "\u2028"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "word " * 3000]
    for name, fast in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        enc = tokenfile.Encoder(public_tokenizers.path(name), 1, keep=900)
        assert (enc.words is not None) == fast
        for part in (texts[:700], texts[700:], texts[:50]):
            ids, n = enc(tokenfile.pa.array(part))
            whole = [[*x, 1] for x in enc.encoded(part)]
            assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


def test_segmentations(spark, odd):
    got = segmentation.sample_segmentations(odd, k=3).collect()
    v = segmentation.vocabulary(public_tokenizers.path(segmentation.MODEL), 1.0)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        assert r.round_trip and len({tuple(s.ids) for s in r.samples}) == len(r.samples) <= 3
        assert all(segmentation.decode(v, s.ids) == texts[r.doc_id] for s in r.samples)
        assert [s.gumbel for s in r.samples] == sorted([s.gumbel for s in r.samples], reverse=True)
        assert all(-1e9 < s.log_inclusion <= 0 for s in r.samples)
    again = {r.doc_id: r.samples for r in segmentation.sample_segmentations(odd.repartition(7), k=3).collect()}
    assert again == {r.doc_id: r.samples for r in got}
    assert segmentation.sample_segmentations(empty(spark)).count() == 0


def test_segmentation_law():
    """Frequencies of first and second draws against the exact law of drawing without replacement."""
    v = segmentation.vocabulary(public_tokenizers.path(segmentation.MODEL), 0.3)
    lat = segmentation.Lattice(v, segmentation.UNIT.findall(segmentation.prepared("the ab")))

    def every(node):
        return [((), 0.0)] if lat.last[node] else [((e, *t), lat.logp[e] + x) for e in range(lat.begin[node], lat.begin[node + 1]) for t, x in every(lat.end[e])]

    p = {a + b: np.exp(x + y) for a, x in every(lat.first[0]) for b, y in every(lat.first[1])}
    assert sum(p.values()) == pytest.approx(1)
    n = 6000
    got = segmentation.samples(lat, [lat.first] * n, list(segmentation.mixed(np.arange(n, dtype=np.uint64))), 2)
    first, second = (collections.Counter(tuple(r[i][0].tolist()) for r in got) for i in (0, 1))
    for key in sorted(p, key=p.get)[-6:]:
        want = sum(p[j] * p[key] / (1 - p[j]) for j in p if j != key)
        assert first[key] / n == pytest.approx(p[key], abs=0.03)
        assert second[key] / n == pytest.approx(want, abs=0.03)
    assert all(x[1] == pytest.approx(np.log(p[tuple(x[0].tolist())])) for r in got[:50] for x in r)
    few = segmentation.Lattice(v, ["▁"])
    assert len(segmentation.samples(few, [few.first], [np.uint64(1)], 5)[0]) == 1


# ---- mixing


def naive_targets(sizes):
    cap, w = {s: 3 * x for s, x in sizes.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        level = (total - sum(full.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level >= cap[s]]
        if not over:
            return full | {s: w[s] * level for s in free}
        full |= {s: cap[s] for s in over}


def test_mixing(spark, odd):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", ["a", "b", "c", "d", None][min(4, rng.randrange(9))], 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    for per in (20_000, 16):
        got = mixing.weighted_mix(df.repartition(3), rows_per_bucket=per).collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r[3]] += len(WORD.findall(r[1]))
        want = naive_targets(sizes)
        taken = collections.Counter()
        for r in got:
            assert r.size == len(WORD.findall(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
            assert r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 60 for s in want) and sum(taken.values()) <= sum(sizes.values())
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.weighted_mix(df, rows_per_bucket=64).collect()), key=str)
    assert mixing.weighted_mix(odd).count() == odd.count()
    assert mixing.weighted_mix(empty(spark)).count() == 0


# ---- pages


def test_extraction(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy.</div><article><h1>Head &amp; x</h1><p>One\n <b>bold</b>ly<p>Two<br>three</p><form>f</form></article><section id="comments"><p>Nice, really.</p></section><footer>&copy;</footer>'
    assert extraction.main_text(page) == "Head & x One boldly Two three"
    free = '<body><div id=menu><a href=a>a</a><a href=b>b</a></div><div class=post><h2>Title</h2><p>A long text, with marks; and more of it.</p><p>Another one, also long enough. Yes.</p></div><div class=comments><p>I liked it.</p></div><div role="contentinfo">imprint</div></body>'
    assert extraction.main_text(free) == "Title A long text, with marks; and more of it. Another one, also long enough. Yes."
    for x in (None, "", "   ", "<", "<p", "<!-- x", "<script>x", "</p></div>"):
        assert extraction.main_text(x) in ("", "<")
    assert extraction.main_text("plain words only") == "plain words only"
    assert len(extraction.main_text("<p>" + "w " * 100_000)) == 199_999
    assert extraction.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extraction.extract_main(df).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 29), (1, 29), (2, 0)]
    assert extraction.extract_main(df.limit(0)).count() == 0


def test_extraction_ratios_on_marked_pages():
    long = "A long text, with marks; and more of it, so that it is dense. " * 4
    for teaser in ("<article><h3>Read too</h3></article>", '<article class="comment"><p>I liked it.</p></article>', "<main></main><div role=main><p>Brief</p></div>"):
        got = extraction.main_text(f"<body><div class=text><h1>Title</h1><p>{long}</p><p>{long}</p></div>{teaser}</body>")
        assert got.startswith(f"Title {long.strip()} {long.strip()}")
        assert "liked" not in got
    marked = f'<body><div><p>Buy now</p></div><article class="post has-comments"><h1>Head</h1><section><p>{long}</p></section><ul><li>one<li>two</ul><table><tr><td>3</table><p>With <a href=x>a link</a>.</p></article></body>'
    assert extraction.main_text(marked) == f"Head {long.strip()} one two 3 With a link."
    assert extraction.main_text("<article><h1><a href=x>All</a></h1><p><a href=y>links</a></p></article>") == "All links"


def test_extraction_inline_links():
    long = "A long text, with marks; and more of it, so that it is dense. " * 2
    menu = "<div><a href=a>Home page</a> | <a href=b>About us</a></div><ul><li><a href=c>Shop</a><li><a href=d>Help</a></ul>"
    page = f"<body>{menu}<div><h2><a href=t>Title</a></h2><p>Long text with <a href=x>a <b>link</b></a> and more. {long}</p><p>{long}</p><p><a href=y>Next part</a></p></div></body>"
    assert extraction.main_text(page) == f"Title Long text with a link and more. {long.strip()} {long.strip()} Next part"
    assert extraction.main_text("<p>Long text with <a href=x>a link</a> and more.</p>") == "Long text with a link and more."
    assert extraction.main_text(f"<body>{menu}<div>{long}<br><a href=x>see there</a><br>{long}</div>") == f"{long.strip()} see there {long.strip()}"
    items = "".join(f"<li>{long}" for _ in range(3))
    assert extraction.main_text(f"<body>{menu}<ul>{items}<li><a href=z>a source</a></ul></body>").endswith("a source")


def test_extraction_raw_elements_and_class_words():
    long = "A long text, with marks; and more of it, so that it is dense."
    for raw in ("<svg class=i width=1 />", "<svg><path d=1>", "<svg><title>i</title><svg/></svg>", "<canvas>", "<math/>", "<video src=v>", "<style>p{}"):
        for after in ("", "<svg><path/></svg>"):
            assert extraction.main_text(f"<article><p>{long}</p>{raw}<p>{long}</p>{after}</article>") == f"{long} {long}", raw
    assert extraction.main_text("<svg><svg></svg>in</svg><p>out</p><script>'<p>'</script>") == "out"
    assert extraction.main_text("<svg>" * 3000 + "<p>out</p>" + "</svg>") == "out"
    assert extraction.main_text(f"<article><p>{long} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p></article>") == f"{long} x=2"
    for words in ("content no-sidebar", "post has-comments", "main-content-side", "layout header-fixed"):
        assert extraction.main_text(f'<body><div class="{words}"><h1>Head</h1><p>{long}</p></div></body>') == f"Head {long}"
    assert extraction.main_text(f'<body><div class="post">{f"<p>{long}" * 6}</div><div class="cookie-bar"><p>We use them, accept.</p></div><div class="related"><p>{long}</p></div></body>') == " ".join([long] * 6)


def test_extraction_statistics_against_a_plain_parser():
    """Lengths, lines and punctuation of every path of well-formed pages, by the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.way, self.block, self.found = [], 0, collections.defaultdict(lambda: [0, set(), 0])

        def handle_starttag(self, tag, attrs):
            if tag not in extraction.INLINE:
                self.way.append(f"{tag}.{dict(attrs).get('class', '')}")
                self.block += 1

        def handle_endtag(self, tag):
            if tag not in extraction.INLINE:
                self.way.pop()
                self.block += 1

        def handle_data(self, data):
            if data.strip():
                s = self.found["/".join(self.way)]
                s[0] += len(data.strip())
                s[1].add(self.block)
                s[2] += len(extraction.PUNCT.findall(data))

    rng = random.Random(12)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Some words, and more. ", "x", " ", "Why? <b>bold!</b> so", "a <a href='q'>link; here</a>"])
        name, words = rng.choice(["div", "section", "ul", "blockquote"]), rng.choice(["", "", " class='one'", ' class="two three"'])
        return f"<{name}{words}>" + "".join(element(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{name}>"

    for _ in range(150):
        page = element(5) + element(4)
        plain = Plain()
        plain.feed(page)
        plain.close()
        nodes, paths = extraction.nodes_of(page)
        s = extraction.Statistics([x for x in nodes if x[0].strip()], paths)
        steps = {number: step for (_, step), number in paths.number.items()}

        def way(path):
            return f"{way(paths.above[path])}/{steps[path]}".lstrip("/") if path else ""

        assert {way(q): (s.length[q], s.lines[q], s.marks[q]) for q in s.length} == {k: (v[0], len(v[1]), v[2]) for k, v in plain.found.items()}


def test_extraction_decides_every_page_by_ratios(spark, monkeypatch):
    seen = []
    plain = extraction.ratio_kept
    monkeypatch.setattr(extraction, "ratio_kept", lambda s, *a: seen.append((len(s.length), plain(s, *a))) or seen[-1][1])
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    texts = [extraction.main_text(x) for x in pages]
    assert len(seen) == len(pages) and all(texts)
    assert all(0 < len(kept) <= n for n, kept in seen)
    # Without any name to go by, the ratios alone find the same text on most pages, and drop something on nearly all.
    bare = [re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", x).replace('<div class="ad">', "<div>") for x in pages]
    assert sum(extraction.main_text(x) == want for x, want in zip(bare, texts, strict=True)) > 0.8 * len(pages)
    whole = [" ".join(e[0] for e in extraction.nodes_of(x)[0]).split() for x in bare]
    assert sum(len(extraction.main_text(x).split()) < len(all_words) for x, all_words in zip(bare, whole, strict=True)) > 0.9 * len(pages)
    # Every text node that goes is dropped by the threshold and not brought back: names hide none before it.
    gone = 0
    for x in pages:
        nodes, paths = extraction.nodes_of(x)
        assert not any(n[2] for n in nodes)
        s = extraction.Statistics([n for n in nodes if n[0].strip()], paths)
        kept = plain(s, 0.6, 0.6)
        gone += sum(n[1] not in kept | extraction.neighbours(s, kept) for n in nodes if n[0].strip())
    assert gone > len(pages)


def test_extraction_keeps_all_parts_of_an_article():
    long = "A long text, with marks; and more of it, so that it is dense. " * 3
    page = f"<body><header><p>Site</p></header><article><header><h1>Title</h1><p>by me</p></header><p>{long}</p><div>short</div><ul><li><a href=a>one</a><li><a href=b>two</a></ul><table><tr><th>A</th><td>1</td></table><dl><dt>t<dd>d</dl></article><aside>side</aside></body>"
    assert extraction.main_text(page) == f"Title {long.strip()} short one two A 1 t d"
    free = f"<body><div><p>{long}</p><table><caption>C</caption><tr><th>A</th><td>1</td></tr></table><ul><li>x</ul></div><form><p>{long}</p></form></body>"
    assert extraction.main_text(free) == f"{long.strip()} C A 1 x"
    for nothing in (f"<nav><p>{long}</p></nav>", f"<footer>{long}</footer><aside>{long}</aside>", f'<div class="cookie">{long}</div>', f"<p hidden>{long}</p>"):
        assert extraction.main_text(nothing) == ""
    short = "<nav><a href=a>A</a></nav><article><h1>Brief.</h1><p>So</p></article><footer>" + long + "</footer>"
    assert extraction.main_text(short) == "Brief. So"


def test_extraction_of_hostile_pages_is_linear():
    import time

    n = 100_000
    for page in ("<p x " * n, '<a "' * n, '<a x="' * n, "<div></b></i></span>" * (n // 4), "<div>" * n + "x", f"<a {'b' * 5 * n}>x", "<svg x " * n, "<svg>" * n, "<!" * n, "<" * n, "<b>" * n + "<div></div>" * n, "<ul><li>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<script>" * n, f"<a ={'= ' * n}>x", '<a x="' + "<b>" * n):
        began = time.process_time()
        extraction.main_text(page)
        assert time.process_time() - began < 15, page[:20]


def test_near_copies_under_one_id_cost_no_more(spark):
    """Different near copies that share an id are joined with their own text alone."""
    rng = random.Random(8)
    base = prose(rng, 200).split()
    rows = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    own, one = (spark.createDataFrame([(7 if shared else r[0], *r[1:]) for r in rows], DOC) for shared in (False, True))
    import time

    took, sizes = [], []
    for df in (own, one):
        began = time.perf_counter()
        sizes.append({(r.component_id, r.n_shingles) for r in jaccard.similar_groups(df, 5, 80).collect()})
        took.append(time.perf_counter() - began)
    assert {c for c, _ in sizes[0]} == {0} and {c for c, _ in sizes[1]} == {7}
    assert took[1] < 1.5 * took[0] + 5
