"""Readers, files, streams, the command line, and functions that no query uses: on literal cases."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from notaflow.functions import dates, ids, lines, text
from notaflow.operators import companies, export, health, layouts, mail, quality, runs
from notaflow.sources import mail as mails
from notaflow.sources import tables
from notaflow.streaming import control


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_semicolon_files(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("﻿tipo_documento;arquivo_origem;valor_total;vencimento;fornecedor_nome\nnfse;a.pdf;1.234,56;2025-03-01;\"X; Y\"\nBOLETO;b.pdf;;x;\n".encode())
    got = tables.documents_csv(spark, f"file://{tmp_path}/d.csv").orderBy("arquivo_origem").collect()
    assert [(r.doc_type, r.tipo_documento, r.valor_total, r.vencimento, r.fornecedor_nome, r.batch_id) for r in got] == [("NFSE", "nfse", 1234.56, dt.date(2025, 3, 1), "X; Y", None), ("BOLETO", "BOLETO", 0.0, None, None, None)]
    (tmp_path / "b.csv").write_bytes("﻿batch_id;valor_compra;valor_boleto;status_conciliacao;data\nemail_20250102_1;10,5;0;CONFERIR;2025-01-03\nemail_x;7;8,25;;\n".encode())
    got = {r.batch_id: r for r in tables.batches_csv(spark, f"file://{tmp_path}/b.csv", F.to_date(F.lit("2025-06-01"))).collect()}
    assert (got["email_20250102_1"].valor_total, got["email_20250102_1"].data_processamento, got["email_20250102_1"].observacoes) == (10.5, dt.date(2025, 1, 2), "[CONFERIR]")
    assert (got["email_x"].valor_total, got["email_x"].data_processamento, got["email_x"].observacoes) == (8.25, dt.date(2025, 6, 1), None)
    (tmp_path / "n.csv").write_text("tipo_documento;link_nfe\nAVISO;https://x\n")
    assert tables.notices_csv(spark, f"file://{tmp_path}/n.csv").first().link_nfe == "https://x"
    (tmp_path / "s.csv").write_text("a;b\n1;x\n")
    assert tables.semicolon_csv(spark, f"file://{tmp_path}/s.csv", "a int, b string").first().a == 1


def test_text_and_json_files(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(f"l{i}" for i in range(50)))
    got = tables.ordered_lines(spark, f"file://{tmp_path}/x.log").orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == [(i, f"l{i}") for i in range(50)]
    assert tables.text_lines(spark, f"file://{tmp_path}/x.log").count() == 50
    (tmp_path / "r.md").write_text("# a\nb")
    assert tables.whole_texts(spark, f"file://{tmp_path}/r.md").first().text == "# a\nb"
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n{broken\n')
    assert sorted(r.a for r in tables.json_lines(spark, f"file://{tmp_path}/j.jsonl", "a int").where("a IS NOT NULL").collect()) == [1, 2]
    (tmp_path / "g.json").write_text('{"generalDiagnostics": [{"file": "f", "severity": "Error", "message": "m2"}, {"file": "f", "severity": "error", "message": "m1"}, {"message": "q"}]}')
    got = {(r.file, r.severity): (r.n, r.messages) for r in tables.diagnostics(spark, f"file://{tmp_path}/g.json").collect()}
    assert got == {("f", "error"): (2, ["m1", "m2"]), ("unknown", "information"): (1, ["q"])}
    report = "head\n" + "-" * 80 + "\nNível de severidade: alta\nValor Issues: 1\nClassificação primária: DESCONHECIDO\n" + "-" * 80 + "\nClassificação primária: BOLETO\nAção recomendada: CORRIGIR_VALORES\n"
    r = tables.report_totals(spark.createDataFrame([(report,)], "text string")).first()
    assert (r.total_cases, r.severity_alta, r.issue_value, r.classification_unknown, r.classification_boleto, r.action_corrigir_valores) == (2, 1, 1, 1, 1, 1)


def test_attachment_files(spark, tmp_path):
    for name in ("b/02.pdf", "b/01.XML", "b/metadata.json", "b/.hidden.pdf", "b/ignored/z.pdf", "b/x.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = tables.attachment_files(spark, f"file://{tmp_path}/b", True)
    assert [r.name for r in tables.in_path_order(got.withColumn("batch", F.lit(1)), "batch").orderBy("doc_seq").collect()] == ["01.XML", "02.pdf"]


def test_readers_and_passwords(spark):
    class Reader:
        def __init__(self, name, least, answer):
            self.name, self.least, self.answer = name, least, answer

        def read(self, content):
            if self.answer is None:
                raise ValueError("damaged")
            return self.answer + content.decode()

    files = spark.createDataFrame([("a", bytearray(b"long enough a text")), ("b", bytearray(b"x"))], "path string, content binary")
    got = {r.path: (r.reader, r.text) for r in mails.texts(files, [Reader("broken", 0, None), Reader("native", 10, ""), Reader("ocr", 3, "ocr ")]).collect()}
    assert got == {"a": ("native", "long enough a text"), "b": ("ocr", "ocr x")}
    assert mails.texts(files, [Reader("never", 99, "")]).where("reader IS NULL AND text = ''").count() == 2

    def opener(content, password):
        if password != "1234":
            raise ValueError
        return content + b"!"

    assert mails.unlocked(b"x", ["1", "1234", "9"], opener) == b"x!" and mails.unlocked(b"x", ["1"], opener) is None


def test_mail_parts(spark):
    sample = spark.createDataFrame([("1", "s", [("a.PDF", bytearray(b"p")), ("b.png", bytearray(b"q"))]), ("2", "t", []), ("3", "u", None)], "email_id string, subject string, parts array<struct<filename:string,content:binary>>")
    got = mails.attachments(sample)
    assert [(r.email_id, r.filename) for r in got.collect()] == [("1", "a.PDF")]
    assert [r.email_id for r in mails.without_attachments(sample, got).orderBy("email_id").collect()] == ["2", "3"]
    assert [r.email_id for r in mails.without_attachments(sample, got, 1).collect()] == ["2"]
    df = spark.createDataFrame([("=?utf-8?b?w6k=?= ok",), ("=?x-unknown?q?=E9?=",), (None,), ("plain",)], "h string")
    assert [r[0] for r in df.select(mails.decoded_header("h")).collect()] == ["é ok", "é", "", "plain"]


def test_line_predicates(spark):
    cases = [("R$ 10", True, False, False), ("Real 1 14.338.304/0001-78 01/09/2025 352,08", True, False, False), ("01/09/2025 352,08", True, False, False), ("352,08", False, False, False),
             ("34191.09008 63571.277308 71444.640008", False, True, False), ("Rua A, 5", False, False, True), ("x - Centro", False, False, True), ("EMPRESA (BETIM/MG)", False, False, True), ("ROTA DO SOL", False, False, False), ("", False, False, False), (None, False, False, False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    s = F.col("s")
    for r in df.select("i", lines.currency_line(s).alias("a"), lines.digit_line(s).alias("b"), lines.address_line(s).alias("c")).collect():
        assert (r.a, r.b, r.c) == cases[r.i][1:], cases[r.i]
    bank = "Agência: 1.234 - 5\nConta Corrente 123456-7\nBanco 341"
    r = one(spark, lines.agency(F.lit(bank)), lines.account(F.lit(bank)), lines.bank_name(F.lit(bank), F.lit(None).cast("string")), lines.bank_name(F.lit(bank), F.lit("00190.5")), lines.bank_name(F.lit("nada"), F.lit(None).cast("string")), lines.bank_name(F.lit(""), F.lit("9999")))
    assert tuple(r) == ("1234-5", "123456-7", "ITAÚ UNIBANCO S.A.", "BANCO DO BRASIL S.A.", None, "BANCO_999")
    name = lines.name_before_cnpj(F.lit("EMPRESA LTDA - CNPJ 12.345.678/0001-90"), F.lit("12.345.678/0001-90"))
    assert one(spark, name, lines.notice(*[F.lit(None).cast("string")] * 3), lines.invalid_goods_supplier(F.lit("Chave de Acesso")), lines.valid_comm_supplier(F.lit("VIVO TELECOM")))[0:4] == ("EMPRESA LTDA", None, True, True)


def test_company_matching(spark):
    own = spark.createDataFrame([("11111111000111", "CSC GESTAO", 1), ("22222222000122", "MASTER SA", 2)], "cnpj string, name string, pos int")
    far = " " + "." * 600 + " "
    rows = [(1, "CNPJ 11.111.111/0001-11" + far + "PAGADOR 22 . 222 . 222 / 0001 - 22"), (2, "conta da csc."), (3, "nf@master.com.br"), (4, "soumaster.com.br cscx"), (5, None), (6, "MASTER e CSC")]
    got = {r.k: (r.code, r.method, r.score) for r in companies.company_of(spark.createDataFrame(rows, "k int, t string"), own, "k", "t").collect()}
    assert got == {1: ("MASTER", "cnpj", 16), 2: ("CSC", "nome", 5), 3: ("MASTER", "nome", 5), 4: (None, None, None), 5: (None, None, None), 6: ("CSC", "nome", 5)}
    r = one(spark, companies.cnpjs_with_offsets(F.lit("a 11111111000111, 11.111.111/0001-11 123456789012345")))
    assert [(x.raw, x.start, x.end) for x in r[0]] == [("11111111000111", 2, 16), ("11.111.111/0001-11", 18, 36)]


def test_functions_of_no_query(spark):
    r = one(spark, ids.is_cpf(F.lit(" 123.456.789-09 ")), ids.is_cpf(F.lit("123")), quality.service_note_ok(F.lit("1"), F.lit(2.0)), quality.reasons(F.lit(None).cast("string"), F.lit(0.0), F.lit("x"), F.lit(None).cast("date")), dates.due_faults(F.lit("00/00/0000")), dates.metadata_date(F.lit("1/2/25")), dates.metadata_date(F.lit("nada")))
    assert r[0] and not r[1] and r[2] and r[3] == ["SEM_NUMERO", "VALOR_ZERO", "SEM_VENCIMENTO"] and "ZERADO" in r[4] and r[5] == "01/02/2025" and r[6] is None
    assert one(spark, F.array_distinct(F.array(*map(F.lit, "baab"))))[0] == ["b", "a"]
    assert one(spark, health.valid_supplier(F.lit("ab")), mail.ignored_attachment(F.lit("logo.pdf")), text.strip_accents(F.lit("Ação")))[0:3] == (False, True, "Acao")


def test_reports_in_text(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert runs.as_text(df, "T").splitlines()[:2] == ["T", "-"] and "| a | 1 |" in runs.as_markdown(df, "T")
    export.write_csv(df, f"file://{tmp_path}/o", "k")
    assert sorted(p.name for p in (tmp_path / "o").glob("k=*")) == ["k=a", "k=b"]
    docs = spark.createDataFrame([("BOLETO", None, "D1", 5.0)], "doc_type string, referencia_nfse string, numero_documento string, valor_documento double")
    assert (lambda r: (r.NF, r.N_FAT, r.VALOR, r.TP_DOC))(layouts.paf_rows(docs).first()) == ("D1", "D1", 5.0, "")


@pytest.fixture
def stream(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 3 AS k").repartition(4).write.parquet(f"{tmp_path}/in")

    def start(name, **options):
        s = spark.readStream.schema("id bigint, k bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        w = control.running_counts(s, "k").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}")
        return w.trigger(**options).start()

    return start


def test_streams_in_phases(spark, stream):
    seen = []
    listener = control.Progress(lambda *a: seen.append(a))
    spark.streams.addListener(listener)
    try:
        out = control.in_phases([("one", lambda: stream("one", availableNow=True)), ("two", lambda: stream("two", availableNow=True))])
        assert out == {"one": "COMPLETED", "two": "COMPLETED"}
        assert sorted((r.k, r.n) for r in spark.table("two").collect()) == [(0, 14), (1, 13), (2, 13)]
    finally:
        import time

        time.sleep(1)
        spark.streams.removeListener(listener)
    assert {name for name, *_ in seen} == {"one", "two"} and sum(n for name, _, n in seen if name == "one") == 40


def test_interrupted_stream(stream):
    stop = threading.Event()
    q = stream("cut", processingTime="1 second")
    while not control.status(q)["rows"]:
        q.awaitTermination(0.2)
    assert control.status(q)["active"]
    stop.set()
    assert control.run_until(q, stop) == "INTERRUPTED" and not q.isActive
    assert control.in_phases([("never", lambda: None)], stop) == {"never": "SKIPPED"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from notaflow import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda master: spark)
    assert cli.main(["queries"]) == 0 and "paf_rows" in capsys.readouterr().out
    assert cli.main(["run", "no_such", "--input", "x"]) == 2
    assert cli.main(["run", "kind_shares", "--input", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/k"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/k").count() == 5
    (tmp_path / "t.txt").write_text("DANFE 1")
    assert cli.main(["route", f"file://{tmp_path}/t.txt", "--out", f"file://{tmp_path}/r"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/r").first().extractor == "danfe"
    (tmp_path / "d.csv").write_text("tipo_documento;arquivo_origem;valor_total\nNFSE;a;1,5\nAVISO;b;\n")
    assert cli.main(["export", f"file://{tmp_path}/d.csv", "--out", f"file://{tmp_path}/x"]) == 0
    assert tables.header_csv(spark, f"file://{tmp_path}/x/paf").count() == 2 and tables.header_csv(spark, f"file://{tmp_path}/x/sem_anexos").count() == 1
    (tmp_path / "b.csv").write_text("batch_id;valor_compra;fornecedor;status_conciliacao\ne;1,5;F;OK\n")
    assert cli.main(["report", f"file://{tmp_path}/b.csv"]) == 0 and "Resumo executivo" in capsys.readouterr().out
    assert cli.main(["cleanup", f"file://{tmp_path}", "--hours", "48", "--out", f"file://{tmp_path}/old"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/old").count() == 0
    spark.createDataFrame([(1, "2025-01-01")], "id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"file://{tmp_path}/in")
    assert cli.main(["ingest", f"file://{tmp_path}/in", f"file://{tmp_path}/sink", "--key", "id", "--ts", "ts", "--state", f"file://{tmp_path}/state"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/sink").count() == 1


def test_sink_with_retries(spark):
    calls, fail = [], [True, False, True, True, False]

    def send(rows):
        if fail and fail.pop(0):
            raise ConnectionError
        calls.append([r[0] for r in rows])

    assert export.send_in_chunks(spark.range(25).repartition(3), ["id"], send, 10, wait_s=0.0) == 25
    assert calls == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    with pytest.raises(ConnectionError):
        export.send_in_chunks(spark.range(1), ["id"], lambda rows: (_ for _ in ()).throw(ConnectionError()), attempts=2, wait_s=0.0)


def test_own_mail_patterns(spark):
    def decided(subject, sender, **more):
        return one(spark, mail.decision(F.lit(subject), F.lit(sender), F.lit(False), F.lit(True), F.lit(False), **more))[0]

    assert decided("Oi", "a@x.com") == "SKIP_NO_SUBJECT_MATCH" and decided("Oi", "a@x.com", white=(r"^oi$",)) == "PROCESS" and decided("Oi", "a@x.com", white_senders=("@x",)) == "PROCESS"
    assert decided("Fatura", "a@x.com", black=("fatura",)) == "SKIP_BLACKLIST" and decided("Fatura", "a@x.com", black_senders=("@x",)) == "SKIP_SENDER_BLACKLIST"


def test_a_table_is_dealt_by_its_rows(spark):
    from notaflow.plans import documents
    from notaflow.sources.tables import spread

    small, large = spark.range(10), spark.range(0, 1000, 1, 1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(small).rdd.getNumPartitions() >= cores
    assert spread(large, 20).rdd.getNumPartitions() == 50
    assert spread(large, 20).count() == 1000
    assert documents.slip_document(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= cores
