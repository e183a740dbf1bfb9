"""The registered queries, and the pipeline's stages."""

import collections
import glob
import os
import re
import sys

import duckdb
import pytest

import corpus_pipeline
from notaflow.llm import registry

sys.path.insert(0, os.path.dirname(__file__))
from test_llm_operators import naive_groups, plain_spans  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = c.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert list(got.columns) == list(want.columns)
    key = list(want.columns)
    assert got.sort_values(key).round(6).to_numpy().tolist() == want.sort_values(key).round(6).to_numpy().tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        if name == "near_copies":
            assert docs.count() == docs.select("doc_id").distinct().count() < before
        if name == "pii":
            assert docs.where("text LIKE '%@mail%.example.com%'").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == docs.count() and out.where("NOT round_trip").count() == 0


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_pipeline_keeps_repeated_and_missing_ids(spark):
    def text(seed):
        return " ".join(f"{seed}{i}" for i in range(40))

    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (None, text("e")), (None, text("f")), (None, text("c")), (None, text("g")), (None, text("g"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_copies_stage(spark, docs, FOLDER).collect()
    want = [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e"), (None, "f"), (None, "g")]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), text(t)) for i, t in want)
    kept = spark.createDataFrame(got, docs.schema)
    mixed = corpus_pipeline.mixing_stage(spark, kept, FOLDER).collect()
    assert {(r.doc_id, r.text) for r in mixed} == {(r.doc_id, r.text) for r in got} and len(mixed) <= len(got) * 3


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string, key string, size string, taken bigint, component_id bigint, spans string, `seed of row` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns that clash."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (5, long, "en", "b", len(long)), (6, "x" * 50_000, "en", "b", 50_000), (7, "mail jo@ex.com now", None, "b", 5), (7, "mail jo@ex.com now", None, "b", 5),
            (7, "another text of this id", "en", "b", 5), (None, None, None, None, None), (None, "no id here at all", "en", "a", 17), (8, long + " end", "en", "c", len(long) + 4)]
    return spark.createDataFrame([(*r, "c", "k", "s", 9, 1, "x", "y") for r in rows], ODD)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    got = stage(spark, odd, FOLDER).collect()
    ids = [(r.doc_id, *([r.text] if name != "segmentation" else [])) for r in got]
    want = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    if name == "quality":  # only drops rows
        assert set(ids) <= want and len(got) <= 12
    if name == "near_copies":  # one row of each group: the repeated row, and the long text's near copy, go
        assert sorted((str(i), (t or "")[:20], len(t or "")) for i, t in ids) == sorted((str(i), (t or "")[:20], len(t or "")) for i, t in want if i != 8)
    if name == "pii":
        masked = {(i, t.replace("jo@ex.com", "<EMAIL>") if t else t) for i, t in want}
        assert len(got) == 12 and set(ids) == masked and all((r.n_chars is None) == (r.text is None) and (r.text is None or r.n_chars == len(r.text)) for r in got)
    if name == "mixing":  # copies of what it takes, of rows with words
        assert set(ids) <= {(i, t) for i, t in want if t and t.split()} and max(map(ids.count, ids)) <= 6
    if name == "segmentation":
        assert len(got) == 12 and all(r.round_trip for r in got)
    if name != "segmentation":
        assert got == [] or set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def plain_mix(rows, keys):
    """Weighted fair queueing of (source, size) rows, one at a time: how often each row is taken."""
    import hashlib

    word = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    docs = [(k, s, word(t), int(hashlib.md5(f"mix:{k}:{t or ''}".encode()).hexdigest()[:15], 16)) for k, (s, t) in zip(keys, rows, strict=True)]
    total = collections.Counter()
    for _, s, n, _ in docs:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight, full, budget = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, sum(total.values())
    while True:
        free = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(weight[s] for s in free) if free else 0
        more = {s: 3 * total[s] for s in free if weight[s] * level >= 3 * total[s]}
        if not more:
            break
        full |= more
    target = full | {s: weight[s] * level for s in free}
    copies, cum = [], collections.Counter()
    for k, s, n, _ in sorted(docs, key=lambda d: (d[3], d[0], d[2])):
        cum[s] += n
        copies += [((e * total[s] + cum[s]) / target[s], k, e, n) for e in range(3)] if n and target[s] else []
    out, run = collections.Counter(), 0
    for _, k, _, n in sorted(copies):
        run += n
        if run > budget:
            break
        out[k] += 1
    return out


def test_pipeline_against_plain_python(spark):
    """All five stages on a small corpus: labels, near copies by all pairs, masks by the fixed rules, the mix a row at a
    time, and segmentations that decode to their text."""
    from notaflow.llm import quality

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 160")
    scored = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if scored[r.doc_id] == 1]
    group = naive_groups([(i, t) for i, t, _ in rows], 5, 80)
    rows = sorted(r for r in rows if group[r[0]][1] == r[0])
    stages = dict(corpus_pipeline.STAGES)
    got = stages["near_copies"](spark, stages["quality"](spark, docs, FOLDER), FOLDER).cache()
    assert sorted((r.doc_id, r.text, r.source) for r in got.collect()) == rows
    masked = stages["pii"](spark, got, FOLDER).cache()
    by_id = {r.doc_id: r.text for r in masked.collect()}
    marks = ("EMAIL", "IP", "CARD", "PHONE")
    for i, text, _ in rows:
        out, end = "", 0
        for s, k, e in plain_spans(text or ""):
            if s >= end:
                out, end = out + (text or "")[end:s] + f"<{marks[k]}>", e
        base = out + (text or "")[end:]
        more = re.sub(r"<(?:SECRET|LOCAL_PHONE|PERSON|NATIONAL_ID|IBAN|BIRTH_DATE|HANDLE)>", "@@", by_id[i] or "")
        assert re.fullmatch(".+?".join(map(re.escape, more.split("@@"))), base, re.S), i
    mixed = stages["mixing"](spark, masked, FOLDER).cache()
    keyed = {r.doc_id: (r.key, r.source, r.text) for r in masked.select("doc_id", "source", "text", corpus_pipeline.row_key().alias("key")).collect()}
    taken = plain_mix([(s, t) for _, s, t in keyed.values()], [k for k, _, _ in keyed.values()])
    assert collections.Counter(keyed[r.doc_id][0] for r in mixed.collect()) == taken
    last = stages["segmentation"](spark, mixed, FOLDER).collect()
    assert len(last) == sum(taken.values()) and all(r.round_trip for r in last)
