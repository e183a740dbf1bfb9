"""Batch operators on the literal cases of the business."""

import datetime as dt

from pyspark.sql import functions as F

from notaflow.functions import xml
from notaflow.operators import batches, export, fields, logs, mail, pairing, router
from notaflow.plans.documents import LAYOUTS


def doc(kind, number, value, name="", line=None):
    keys = {"2025/119": "119", "2025.119": "119", "2025/122": "122", "2025.122": "122", None: ""}
    return {"doc_type": kind, "key": keys.get(number, number), "valor": value, "arquivo_origem": name or f"{kind}-{number}", "linha_digitavel": line}


def statuses(*docs, **how):
    return [p["pair_status"] for p in pairing.pair_batch(list(docs), **how)]


def test_pairing_cases():
    assert statuses(doc("NFSE", "123", 1000.0), doc("BOLETO", "123", 1000.0)) == ["CONCILIADO"]
    got = pairing.pair_batch([doc("NFSE", "456", 1000.0), doc("BOLETO", "456", 900.0)])
    assert [(p["pair_status"], p["difference"]) for p in got] == [("DIVERGENTE", 100.0)]
    assert statuses(doc("NFSE", "789", 500.0)) == ["CONFERIR"]
    assert statuses(doc("NFSE", "2025/119", 9290.71), doc("BOLETO", "2025.119", 9290.71), doc("NFSE", "2025/122", 6250.0), doc("BOLETO", "2025.122", 6250.0)) == ["CONCILIADO"] * 2
    assert statuses(doc("NFSE", "100", 1000.0), doc("BOLETO", "100", 1000.0), doc("NFSE", "200", 500.0)) == ["CONCILIADO", "CONFERIR"]
    assert statuses(doc("OUTRO", None, 352.08), doc("BOLETO", None, 352.08)) == ["CONCILIADO"]
    assert statuses(doc("OUTRO", None, 100.0, "a"), doc("OUTRO", None, 200.0, "b"), doc("BOLETO", None, 100.0, "c"), doc("BOLETO", None, 200.0, "d")) == ["CONCILIADO"] * 2
    assert statuses(doc("NFSE", "1", 0.0), doc("BOLETO", "2", 70.0)) == ["PAREADO_FORCADO"]
    assert statuses() == ["CONFERIR"]
    assert statuses(doc("BOLETO", "5", 10.0)) == ["CONFERIR"]
    notes = [doc("NFSE", "31", 360.0), doc("NFSE", "42", 240.0), doc("BOLETO", "77", 600.0)]
    assert statuses(*notes) == ["CONFERIR", "CONFERIR", "CONCILIADO"]
    assert statuses(*notes, strict=False) == ["CONCILIADO"]


def test_pairing_keeps_every_document():
    docs = [doc("NFSE", str(i), 10.0 * i) for i in range(1, 6)] + [doc("BOLETO", str(i), 10.0 * i + 1) for i in range(3, 9)]
    pairs = pairing.pair_batch(docs)
    assert {d for p in pairs for d in p["note_docs"] + p["slip_docs"]} == {d["arquivo_origem"] for d in docs}


def test_tolerance_is_raw_for_matching_and_rounded_for_status():
    assert pairing.pair_status(100.01, 100.0) == ("CONCILIADO", 0.01)
    assert len(pairing.pair_batch([doc("NFSE", None, 100.01), doc("BOLETO", None, 100.0)])) == 2


def test_pairing_frame(spark):
    rows = [("b1", 1, "NFSE", "n", "12", 5.0, None), ("b1", 2, "BOLETO", "s", "12", 5.0, None), ("b2", 1, "BOLETO", "t", None, 7.0, None)]
    df = spark.createDataFrame(rows, "batch_id string, doc_seq int, doc_type string, arquivo_origem string, numero string, valor double, linha_digitavel string")
    got = {(r.batch_id, r.pair_status) for r in pairing.pair_documents(df).collect()}
    assert got == {("b1", "CONCILIADO"), ("b2", "CONFERIR")}


def test_status_and_inheritance(spark):
    df = spark.createDataFrame([(1000.0, 1000.0), (1000.0, 800.0), (1000.0, None)], "p double, s double")
    state, diff = batches.status(F.col("p"), F.col("s"))
    assert [(r.a, r.b) for r in df.select(state.alias("a"), diff.alias("b")).collect()] == [("CONCILIADO", 0.0), ("DIVERGENTE", 200.0), ("CONFERIR", 1000.0)]
    docs = spark.createDataFrame([("b", 1, "DANFE", "12345", None, None, None), ("b", 2, "BOLETO", None, dt.date(2024, 12, 31), None, "77")], "batch_id string, doc_seq int, doc_type string, numero string, vencimento date, referencia_nfse string, numero_pedido string")
    got = {r.doc_type: r for r in batches.inherit(docs).collect()}
    assert got["BOLETO"].referencia_nfse == "12345" and got["DANFE"].vencimento == dt.date(2024, 12, 31) and got["DANFE"].numero_pedido == "77"


def test_what_a_task_sorts_to_inherit_does_not_grow(spark):
    def docs(n):
        i = F.col("id")
        return spark.range(n).select((i % (n // 4)).cast("string").alias("batch_id"), i.alias("doc_seq"), F.element_at(F.array(*map(F.lit, ("NFSE", "DANFE", "BOLETO", "OUTRO"))), (i * 7 % 11 % 4 + 1).cast("int")).alias("doc_type"), F.when(i % 3 == 0, i.cast("string")).alias("numero"),
                                     F.when(i % 5 == 0, F.concat(F.lit("P"), i)).alias("numero_pedido"), F.lit(None).cast("string").alias("referencia_nfse"), F.when(i % 2 == 0, F.lit(dt.date(2025, 1, 1))).alias("vencimento"))

    def mails(n):
        return spark.range(0, n, 3).select(F.col("id").cast("string").alias("batch_id"), F.lit(dt.date(2030, 1, 1)).alias("vencimento_email"), F.lit("E1").alias("numero_email"))

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (6000, 24000):
            few = batches.inherit_all(docs(n), mails(n // 4), rows=500)
            for out in (few, batches.inherit(docs(n), rows=500)):
                assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 1000
            assert few._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2
            assert sorted(map(repr, few.collect())) == sorted(map(repr, batches.inherit_all(docs(n), mails(n // 4), rows=n * 2).collect()))
        many = batches.inherit_all(docs(400), mails(24000), rows=500)  # far more mails than documents
        assert many._jdf.queryExecution().executedPlan().toString().count(", 17)") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_every_mail_has_one_decision(spark):
    rows = [("Nota Fiscal", "a@x.com", True, False, False, "PROCESS"), ("Nota Fiscal", "a@github.com", False, True, False, "SKIP_SENDER_BLACKLIST"), ("Feliz Natal", "a@x.com", False, True, False, "SKIP_BLACKLIST"),
            ("Nota Fiscal", "a@x.com", False, False, False, "SKIP_NO_CONTENT"), ("Fatura", "a@x.com", False, True, False, "PROCESS"), ("Oi", "nfe@x.com", False, False, True, "PROCESS"), ("Oi", "a@x.com", False, True, True, "SKIP_NO_SUBJECT_MATCH"), (None, None, False, True, False, "SKIP_NO_SUBJECT_MATCH")]
    df = spark.createDataFrame(rows, "s string, f string, a boolean, l boolean, c boolean, want string")
    got = df.select("want", mail.decision(F.col("s"), F.col("f"), F.col("a"), F.col("l"), F.col("c")).alias("d")).collect()
    assert all(r.want == r.d for r in got)


def test_complement_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), rng.choice([None, "x", "y"]), rng.randint(0, 400) if rng.random() < 0.95 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint")
    got = {r.doc_id: (r.x_id, r.lang) for r in batches.complement_near(df, df.withColumnRenamed("doc_id", "x_id"), ["source"], "n_chars", 20, "doc_id", "x_id", ["lang"]).collect()}
    want = {i: (None, lang) for i, _, lang, _ in rows}
    for (i, s, lang, n), (j, t, other, m) in itertools.product(rows, rows):
        if i != j and s == t and n is not None and m is not None and abs(n - m) < 20 and (want[i][0] is None or j < want[i][0]):
            want[i] = (j, lang if lang is not None else other)
    assert got == want


def test_router_subtypes_and_receipts(spark):
    cases = [("TIM S.A. VENCIMENTO 01/02/2025", "tim", "UTILITY_BILL", "TELECOM"), ("CNPJ 02.421.421/0001-11", "tim", "UTILITY_BILL", "TELECOM"), ("Meu TIM www.tim.com.br", "tim", "UTILITY_BILL", "TELECOM"), ("Meu TIM", None, None, None),
             ("DADOS DE QUEM ESTÁ PAGANDO", "comprovante", "OUTRO", "COMPROVANTE_BANCARIO"), ("TED REALIZADO", "comprovante", "OUTRO", "COMPROVANTE_BANCARIO"), ("TED REALIZADO BOLETO", None, None, None),
             ("FAVORECIDO ORDENANTE ITAÚ", "comprovante", "OUTRO", "COMPROVANTE_BANCARIO"), ("FAVORECIDO ORDENANTE", None, None, None), ("AGENCIA ITAU AUTENTICACAO", None, None, None),
             ("CONTA DE LUZ consumo 120 KWH", "utility", "UTILITY_BILL", "ENERGY"), ("LOCAWEB servicos mensais", "outros", "OUTRO", "FATURA")]
    df = spark.createDataFrame([(c[0],) for c in cases], "text string")
    got = {r.text: (r.extractor, r.doc_type, r.subtype) for r in router.routed(df).collect()}
    for text, *want in cases:
        assert got[text] == tuple(want), text
    own = router.Rule("minha", "OUTRO", router.has("MINHAREGRA"), "MEU")
    r = router.routed(spark.createDataFrame([("minha regra DANFE",)], "text string"), more=(own,)).first()
    assert (r.extractor, r.doc_type, r.subtype) == ("minha", "OUTRO", "MEU")


def test_router_order(spark):
    texts = [(x[0], x[1], x[2].replace("{k}", "7").replace("{v}", "1.234,56").replace("{d}", "01/02/2025")) for x in LAYOUTS]
    df = spark.createDataFrame(texts + [(None, None, ""), (None, None, None)], "want string, kind string, text string")
    for r in router.routed(df).collect():
        assert (r.extractor, r.doc_type) == (r.want, r.kind), r.text
    assert len({r.name for r in router.rules()}) == 25


def test_field_shapes(spark):
    df = spark.createDataFrame([("ISS 9,00 retido\npago 50,00 hoje\nVencimento\n\n01/02/2025\nEmissao 03/02/2025 venc 05/02/2025",), (None,), ("",)], "text string")
    t = F.col("text")
    r = df.select(fields.largest_of(t).alias("big"), fields.outside(t, fields.AMOUNT, "iss|reten", fields.amount_of, 5, 1).alias("out"), fields.below_label(t, "^vencimento", fields.DAY, fields.dates.parse_br).alias("below"),
                  fields.scored(t, fields.DAY, {"venc": 3, "emiss": -3}, fields.dates.parse_br, 6, 0).alias("scored"), fields.latest_day(t).alias("last")).collect()
    assert (r[0].big, r[0].out, r[0].below, r[0].scored, r[0].last) == (50.0, 50.0, dt.date(2025, 2, 1), dt.date(2025, 2, 5), dt.date(2025, 2, 5))
    assert all(v is None for row in r[1:] for v in row)


def test_xml_faults_give_nulls(spark):
    df = spark.createDataFrame([("<a><b>",), ("text",), (None,), ("<a>&bad;</a>",)], "xml string")
    assert [r.ok for r in xml.fields(df).collect()] == [False] * 4


def test_records_and_cells(spark):
    lines = spark.createDataFrame([("s", 1, "2025-01-01 10:00:00 - core - ERROR - boom"), ("s", 2, "  at x"), ("s", 3, "2025-01-01 10:00:01 - core - INFO - ok")], "f string, n int, value string")
    assert [(r.level, r.message) for r in logs.records(lines, "f", "n").orderBy("rec").collect()] == [("ERROR", "boom\n  at x"), ("INFO", "ok")]
    one = spark.range(1).select(export.decimal_comma(F.lit(1234.5)).alias("a"), export.clean_cell(F.lit("x;\ny")).alias("b")).first()
    assert (one.a, one.b) == ("1234,50", "x y")


def test_ingestion_of_old_and_late_messages(spark, tmp_path):
    from notaflow.streaming.ingest import run_once

    schema = "id bigint, ts timestamp, body string"

    def deliver(name, rows):
        spark.createDataFrame(rows, "id bigint, ts string, body string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in/{name}")
        run_once(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/state", "id", "ts")
        return sorted((r.id is None, r.id or 0, r.body) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    deliver("a", [(1, "2024-01-01", "a"), (2, "2024-06-01", "b"), (2, "2024-06-02", "again"), (None, "2024-06-01", "n")])
    deliver("b", [(3, "2023-01-01", "old"), (4, "2025-06-01", "c")])
    got = deliver("c", [(1, "2025-07-01", "newer"), (5, "2022-01-01", "older"), (None, "2024-06-01", "n"), (None, "2024-06-01", "m")])
    assert got == [(False, 1, "a"), (False, 2, "b"), (False, 3, "old"), (False, 4, "c"), (False, 5, "older"), (True, 0, "m"), (True, 0, "n")]


def test_nearest_of_all_queries(spark):
    from notaflow.operators import vectors

    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [float("nan"), 1.0]), (20, [9.0, 9.0]), (0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for blocks, chunks in ((4096, 1024), (16, 2)):
        got = sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in vectors.nearest_all(df, df.where("vec_id % 20 = 0"), 5, block_rows=blocks, chunk_rows=chunks).collect())
        good, want = [(i, v) for i, v in rows if v and len(v) == 2 and v[0] == v[0]], []
        for q, x in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, v in good)[:5]
            want += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
        assert got == sorted(want)


def test_pairs_of_batches_that_records_split(spark):
    """A batch's documents come in several record batches, and many batches in one task; no grouped map, a batch a call."""
    rows = [(f"b{i}", j, ("NFSE", "BOLETO")[j % 2], f"{i}_{j}", str(j // 2 + 1000 * i + 1), 10.0 * i + j // 2 + 1, None) for i in range(40) for j in (5, 0, 3, 1, 4, 2)]
    df = spark.createDataFrame(rows, "batch_id string, doc_seq int, doc_type string, arquivo_origem string, numero string, valor double, linha_digitavel string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        out = pairing.pair_documents(df)
        got = sorted((r.batch_id, r.pair_status, *r.note_docs, *r.slip_docs) for r in out.collect())
    finally:
        spark.conf.set(key, before)
    assert got == sorted((f"b{i}", "CONCILIADO", f"{i}_{j}", f"{i}_{j + 1}") for i in range(40) for j in (0, 2, 4))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_pair_queries_read_lines_once(spark):
    from notaflow.plans import batch

    for query in (batch.pair_exact, batch.pair_fields):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_extendedprice#") and sum("Relation" in x and "l_extendedprice" in x for x in plan.splitlines()) == 1
