"""Queries over report layouts, batch summaries, run totals, mail headers and text reports."""

from pyspark.sql import functions as F

from ..operators import mail as mail_rules
from ..operators import batches, layouts, logs, quality, runs
from ..sources import mail, tables
from ..sources.tables import table
from .batch import PROBLEM_SQL, with_problems

KINDS = ("NFSE", "DANFE", "BOLETO", "OUTRO", "AVISO")
STATES = ("", "CONCILIADO", "OK")


def sheet_docs(spark, d):
    """A document for each order: its kind, and which fields it has, hang on its key."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 5 + 1).cast("int"))
    text = lambda name, every: F.when(k % every != 0, F.concat(F.lit(name), k))
    return table(spark, d, "orders").select(
        "o_orderkey", kind.alias("doc_type"), day.alias("data_processamento"), F.date_sub(day, 1).alias("data_emissao"), F.when(k % 3 != 0, F.date_add(day, 9)).alias("vencimento"), day.alias("email_date"),
        text("F", 7).alias("fornecedor_nome"), text("N", 4).alias("numero_nota"), text("D", 3).alias("numero_documento"), text("R", 2).alias("referencia_nfse"), text("T", 6).alias("numero_fatura"), text("P", 9).alias("numero_pedido"),
        F.round("o_totalprice", 2).alias("valor_total"), F.when(k % 8 != 0, F.round("o_totalprice", 2)).alias("valor_documento"), F.lit("FT").alias("tipo_doc_paf"), F.when(k % 10 == 0, F.lit("visto")).alias("observacoes"),
        F.when(k % 2 == 0, F.concat(F.lit("https://x.example/"), F.repeat(F.lit("y"), (k % 90).cast("int")))).alias("link_nfe"), text("C", 3).alias("codigo_verificacao"), text("Assunto ", 11).alias("email_subject"), F.lit("Completo").alias("email_subject_full"),
        F.element_at(F.array(*map(F.lit, STATES)), (F.floor(k / 5) % 3 + 1).cast("int")).alias("status_conciliacao"), F.when(k % 3 == 0, F.lit("CONFERIR")).otherwise(F.lit("OK")).alias("situacao"), F.when(k % 3 == 0, F.lit("sem data")).otherwise(F.lit("")).alias("avisos"))


def paf_rows(spark, d):
    return layouts.paf_rows(sheet_docs(spark, d), keep=("o_orderkey",))


def paf_rows_without_number(spark, d):
    return layouts.paf_rows(sheet_docs(spark, d), True, keep=("o_orderkey",)).select("o_orderkey", "NF", "N_FAT")


def anexos_rows(spark, d):
    return layouts.anexos_rows(sheet_docs(spark, d).where("doc_type <> 'AVISO'"), keep=("o_orderkey",))


def sem_anexos_rows(spark, d):
    return layouts.sem_anexos_rows(sheet_docs(spark, d).where("doc_type = 'AVISO'"), keep=("o_orderkey",))


def simple_notices(spark, d):
    n = sheet_docs(spark, d).where("doc_type = 'AVISO'").select(F.col("o_orderkey").cast("string").alias("email_id"), F.col("email_subject").alias("subject"), "link_nfe", "codigo_verificacao")
    return layouts.simple_notices(n)


def partial_export(spark, d):
    """Stored batches with their documents, flattened."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("numero"), F.col("l_returnflag").alias("doc_type"))).alias("documents"))
    b = li.select(F.concat(F.lit("b"), "l_orderkey").alias("batch_id"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("Assunto")).alias("email_subject"), "documents")
    return layouts.partial_documents(b)


def partial_notices(spark, d):
    n = sheet_docs(spark, d).where("doc_type = 'AVISO'")
    return layouts.partial_notices(n.select(F.col("o_orderkey").cast("string").alias("email_id"), F.col("fornecedor_nome").alias("sender_name"), F.col("email_subject").alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, F.col("email_subject_full")).alias("email_subject_full"), "numero_nota", "link_nfe"))


def order_docs(spark, d):
    """The lines of an order as documents of a batch."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 5 + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), (n.cast("bigint") * 10**12 + k * 10**5 + F.col("l_suppkey")).alias("doc_seq"), kind.alias("doc_type"), F.when(k % 3 != 0, F.concat(F.lit("S"), "l_suppkey")).alias("fornecedor_nome"),
                                              F.when(F.col("l_suppkey") % 2 == 0, F.col("l_shipdate").cast("date")).alias("vencimento"), F.when(k % 4 == 0, k.cast("string")).otherwise(F.lit("")).alias("numero_nota"), F.when(k % 7 == 0, F.concat(F.lit("P"), k)).alias("numero_pedido"), F.when(k % 6 != 0, F.round("l_extendedprice", 2)).otherwise(0.0).alias("valor"))


def batch_summary(spark, d):
    o = table(spark, d, "orders")
    b = o.select(F.col("o_orderkey").alias("batch_id"), F.concat(F.lit("/in/"), "o_orderkey").alias("source_folder"), F.col("o_orderpriority").alias("email_subject"), F.col("o_orderstatus").alias("email_sender"), (F.col("o_orderkey") % 3).cast("int").alias("total_errors"))
    return runs.batch_summary(order_docs(spark, d), b)


def multiple_invoices(spark, d):
    return runs.has_multiple_invoices(order_docs(spark, d))


def due_flags(spark, d):
    docs = runs.due_flag(order_docs(spark, d))
    text = runs.divergence(F.when(F.col("doc_type") == "BOLETO", F.lit("dif")), F.col("doc_type") == "OUTRO", F.col("sem_vencimento"))
    return docs.select("batch_id", "doc_seq", "sem_vencimento", text.alias("divergencia"))


def kind_shares(spark, d):
    return runs.shares(order_docs(spark, d), "doc_type")


def document_union(spark, d):
    """XML, PDF and body documents of a batch: notes are XML, slips and goods PDF, the rest a mail's body."""
    docs = order_docs(spark, d)
    xml = docs.where("doc_type = 'NFSE'")
    return runs.documents_of(xml, docs.where("doc_type IN ('DANFE', 'BOLETO')"), docs.where("doc_type IN ('OUTRO', 'AVISO')")).select("batch_id", "doc_seq", "doc_type")


def log_records(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("Nfse", "Boleto", "Danfe"))), (k % 3 + 1).cast("int"))
    text = F.when(k % 5 < 2, F.concat(F.lit("Testando extrator: "), name)).when(k % 5 < 4, F.concat(F.lit("Resultado do can_handle de "), name, F.when(k % 2 == 0, F.lit(": True")).otherwise(F.lit(": False")))).otherwise(F.lit("Nenhum extrator compatível"))
    return e.select("event_id", F.col("user_id").alias("batch"), text.alias("message"))


def extractor_usage(spark, d):
    return runs.extractor_usage(log_records(spark, d))


def extractors_of_batches(spark, d):
    r = runs.extractors_of_batches(log_records(spark, d), "event_id")
    return r.select("batch", F.array_join("tried", ",").alias("tried"), "used", "unmatched")


def slowest_batches(spark, d):
    return runs.slowest(table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("duration")), "user_id", "duration")


def validation_totals(spark, d):
    return runs.validation_totals(order_docs(spark, d).withColumn("ok", F.col("valor") > 0))


def session_totals(spark, d):
    name = F.when(F.col("event_type") == "view", F.lit("emails_scanned")).when(F.col("event_type") == "error", F.lit("emails_errors")).when(F.col("event_type") == "click", F.lit("emails_processed")).otherwise(F.lit("other"))
    c = table(spark, d, "events").groupBy(name.alias("name"), (F.col("user_id") % 4).alias("label")).agg(F.count("*").cast("double").alias("value"))
    return runs.session_summary(c)


def run_totals(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("OK", "TIMEOUT", "ERROR"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return runs.run_summary(table(spark, d, "orders").select(F.col("o_custkey").alias("total_documents"), (F.col("o_orderkey") % 2).alias("total_errors"), F.round("o_totalprice", 2).alias("valor_compra"), state.alias("status")))


def ingestion_totals(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 3 == 0).alias("has_attachment"), F.when(F.col("page_id") % 4 == 0, F.lit("SKIP_NO_CONTENT")).otherwise(F.lit("PROCESS")).alias("decision"))
    return runs.ingestion_totals(p, table(spark, d, "documents"), table(spark, d, "customer"))


def cases(spark, d):
    issue = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("Valor_Zero"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.lit("ALTA")).otherwise(F.lit("BAIXA")).alias("severity"), F.when(F.col("o_custkey") % 2 == 0, F.lit("NFSE")).otherwise(F.lit("BOLETO")).alias("classification"), issue.alias("issues"))


def case_filter(spark, d):
    return runs.filtered_cases(cases(spark, d), "alta", "nfse", "valor_zero", 10, 100_000).select("id")


def csv_quality(spark, d):
    k = F.col("o_orderkey")
    subject = F.element_at(F.array(*map(F.lit, ("Boleto mensal", "Nota fiscal", "Vence hoje", "Ola"))), (k % 4 + 1).cast("int"))
    faults = F.when(k % 7 == 0, F.array(F.lit("ZERADO"))).when(k % 7 == 1, F.array(F.lit("FORMATO"))).otherwise(F.array().cast("array<string>"))
    due = F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("10/10/2025"))
    issues = runs.case_issues(subject, F.when(k % 5 == 0, F.array(F.lit("curto"))).otherwise(F.array().cast("array<string>")), due, faults, F.when(k % 2 == 0, F.lit(0.0)).otherwise(1.0), F.when(k % 6 != 0, F.lit("1")), (k % 2).cast("int"), (k % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", issues.alias("i")).select("o_orderkey", *[F.array_join(f"i.{c}", ";").alias(c) for c in ("supplier", "due", "value", "number", "kind", "dates")])


def unseen_files(spark, d):
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return runs.unseen(files, table(spark, d, "labels").select(F.concat(F.lit("web/"), F.col("doc_id").cast("string")).alias("path")))


def common_files(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("a"), F.sort_array(F.collect_set("l_linenumber")).alias("b"))
    return li.select("l_orderkey", F.array_join(F.array_sort(runs.common_files(F.col("a"), F.col("b").cast("array<bigint>"))).cast("array<string>"), ",").alias("common"))


def merged_labels(spark, d):
    e = table(spark, d, "events")
    m = runs.labelled(F.create_map(F.lit("type"), F.col("event_type"), F.lit("u"), F.lit("0")), F.create_map(F.lit("u"), (F.col("user_id") % 3).cast("string"), F.lit("z"), F.lit("1")))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("labels"))


SENDERS = ('"Loja {k}" <loja{k}@x.com>', "{k}@y.com", "A <B> C <c{k}@z.com>", "<so@w.com>", "  ")
HEADERS = ("=?utf-8?q?Nota_Fiscal_=C3=A9_{k}?=", "Fatura {k}", "=?iso-8859-1?q?=E9?= {k}")


def _templated(values, key):
    return F.element_at(F.array(*[F.replace(F.lit(v), F.lit("{k}"), key.cast("string")) for v in values]), (key % len(values) + 1).cast("int"))


def mail_headers(spark, d):
    k = F.col("o_orderkey")
    day = F.to_date(F.lit("2020-01-01"))
    received = F.when(k % 4 == 0, F.array(F.lit("from a by b"), F.lit("from c; nonsense"), F.lit("from d; Wed, 24 Dec 2025 10:30:00 -0300"))).otherwise(F.array(F.lit("by x")))
    o = table(spark, d, "orders").select("o_orderkey", mail.decoded_header(_templated(HEADERS, k)).alias("subject"), mail.sender(_templated(SENDERS, k)).alias("s"), mail.mail_date(F.when(k % 2 == 1, F.lit("Tue, 02 Dec 2025 08:00:00 -0300")).otherwise(F.lit(" ")), received, day).alias("day"))
    return o.select("o_orderkey", "subject", F.col("s.name").alias("name"), F.col("s.address").alias("address"), "day")


#: Subject and body of a mail, {k} a number of five digits; the number found, and what stands right before it in its text (of the subject first).
NUMBERED = (
    ("Fatura {k}", "NF 999", "{k}", "Fatura "), ("FATURA: Nº {k}", "", "{k}", "Nº "), ("Boleto", "segue NF-e: {k} ok", "{k}", "NF-e: "), ("", "a NFS-e {k}", "{k}", "NFS-e "), (None, "Nota Fiscal Nº {k}", "{k}", "Nº "),
    ("Nº: {k}", None, "{k}", "Nº: "), ("x", "Número: {k}", "{k}", "Número: "), ("Doc. {k}", "y", "{k}", "Doc. "), ("nota fatura - 2025-44", "", "2025-44", "fatura - "), ("NF 2025", "Fatura {k}", "{k}", "Fatura "),
    ("veja", "https://x.br/NF99999 Nota Fiscal {k}", "{k}", "Fiscal "), ("veja", '<img src="fatura 12345"> fatura {k}', "{k}", "fatura "), ("nota 2017-01-20-b.png", "nada", None, None), ("Fatura 12", "", None, None), ("NF 2024", "NF 2026", None, None),
)


def mail_numbers(spark, d):
    """Numbers in mails, and where they stand in the text as it was."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("k", F.lpad((k % 89999 + 10000).cast("string"), 5, "0"))
    subject, body = (F.replace(F.element_at(F.array(*[F.lit(x[i]).cast("string") for x in NUMBERED]), (k % len(NUMBERED) + 1).cast("int")), F.lit("{k}"), F.col("k")) for i in (0, 1))
    return o.select("o_orderkey", mail_rules.number_in_mail(subject, body).alias("n")).select("o_orderkey", "n.number", "n.start")


def _texts(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "][o_orderkey % " + str(len(NUMBERED)) + " + 1]"


NUMBERS_SQL = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 89999 + 10000 AS VARCHAR) AS k, {_texts(x[0] for x in NUMBERED)} AS s, {_texts(x[1] for x in NUMBERED)} AS t, {_texts(x[2] for x in NUMBERED)} AS n, {_texts(x[3] for x in NUMBERED)} AS w FROM orders),
p AS (SELECT o_orderkey, replace(n, '{{k}}', k) AS number, w, replace(w || n, '{{k}}', k) AS needle, replace(coalesce(s, ''), '{{k}}', k) AS s, replace(coalesce(t, ''), '{{k}}', k) AS t FROM o)
SELECT o_orderkey, number, CAST(CASE WHEN contains(s, needle) THEN strpos(s, needle) ELSE strpos(t, needle) END - 1 + length(w) AS INTEGER) AS start FROM p"""


def mail_bodies(spark, d):
    p = table(spark, d, "pages")
    plain = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("texto "), F.col("page_id").cast("string")))
    b = p.select("page_id", mail.body(plain, F.when(F.col("page_id") % 2 == 0, F.col("html"))).alias("b"))
    return b.select("page_id", mail.plain_part(F.col("b")).alias("plain"), F.length(mail.html_part(F.col("b"))).alias("html_length"))


def native_texts(spark, d):
    """Which of a plain and a layout reading of a text layer is taken."""
    docs = table(spark, d, "documents")
    simple = F.when(F.col("doc_id") % 4 == 0, F.lit("curto")).when(F.col("doc_id") % 4 == 1, F.repeat(F.lit("a"), 200)).otherwise(F.col("text"))
    return docs.select("doc_id", F.length(mail.native_text(simple, F.concat(F.lit("b"), F.col("text")))).alias("n"))


def exported_batches(spark, d):
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").select(
        F.when(k % 3 == 0, F.concat(F.lit("email_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_1"))).when(k % 3 == 1, F.lit("email_x")).alias("batch_id"), F.col("o_orderdate").cast("date").alias("data"), F.lit("E").alias("empresa"), F.concat(F.lit("F"), k).alias("fornecedor"),
        F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("numero_nota"), F.round("o_totalprice", 2).alias("valor_compra"), F.when(k % 5 == 0, F.lit(7.5)).when(k % 5 == 1, F.lit(0.0)).alias("valor_boleto"), F.lit(None).cast("date").alias("vencimento"),
        F.when(k % 4 == 0, F.lit("CONFERIR")).alias("status_conciliacao"), F.when(k % 6 == 0, F.lit("dif 1")).otherwise("").alias("divergencia"), F.lit("a").alias("email_subject"))
    return tables.batch_rows(b, F.to_date(F.lit("2025-06-01"))).select("data_processamento", "fornecedor_nome", "numero_documento", "valor_total", "observacoes")


def diagnostics_by_file(spark, d):
    e = table(spark, d, "events").where("event_id % 10 < 3")
    return tables.by_file_and_severity(e.select(F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("f"), F.col("user_id") % 7)).alias("file"), F.when(F.col("event_type") != "view", F.upper("event_type")).alias("severity"), F.col("event_id").cast("string").alias("message"))).select("file", "severity", "n", F.col("messages")[0].alias("first"))


def report_totals(spark, d):
    k = F.col("o_orderkey")
    case = F.concat(F.lit("-" * 80), F.lit("\nNível de severidade: "), F.element_at(F.array(*map(F.lit, ("alta", "MEDIA", "outra"))), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, F.lit("\nValor Issues: 1")).otherwise(F.lit("\nFornecedor Issues: 2")),
                    F.lit("\nClassificação primária: "), F.element_at(F.array(*map(F.lit, ("DESCONHECIDO", "NFSE", "BOLETO", "documentos administrativos"))), (k % 4 + 1).cast("int")), F.lit("\nAção recomendada: "), F.when(k % 5 == 0, F.lit("MELHORAR_EXTRACAO")).otherwise(F.lit("nenhuma")), F.lit("\n"))
    return tables.report_totals(table(spark, d, "orders").select(F.concat(F.lit("cabeçalho\n"), case, case).alias("text")))


def path_order(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey").alias("path"))
    return tables.in_path_order(li, "l_orderkey")


def inherit_all(spark, d):
    """Lines of an order as documents; every third batch has a mail with a due date and a number."""
    docs = order_docs(spark, d).where("doc_type <> 'AVISO'").withColumnRenamed("numero_nota", "numero").withColumn("referencia_nfse", F.when(F.col("valor") == 0, F.lit("R")))
    m = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("batch_id"), F.lit("2030-01-01").cast("date").alias("vencimento_email"), F.lit("E1").alias("numero_email"))
    return batches.inherit_all(docs, m).select("batch_id", "doc_seq", "doc_type", "numero", "numero_pedido", "referencia_nfse", "vencimento")


def status_texts(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, 0.0).otherwise(F.round("o_totalprice", 2))
    slip = F.when(k % 3 == 0, value).when(k % 3 == 1, F.round("o_totalprice", 2) + 5)
    state, text = batches.status_text(value, slip, F.when(k % 7 == 0, F.array(F.lit("1"), F.lit("2"))), k % 7 == 1, F.when(k % 11 == 0, F.lit("Distrato")), k % 13 == 0)
    return table(spark, d, "orders").select("o_orderkey", state.alias("status"), text.alias("text"))


def problem_samples(spark, d):
    p = with_problems(spark, d)
    out = quality.with_samples(p, F.col("note").cast("decimal(18,2)"), F.col("o_orderkey").cast("string"), F.col("o_orderkey"))
    return out.select("kind", "max_severity", "n", F.col("total").cast("double").alias("total"), F.array_join("samples", ",").alias("samples"))


def batch_pace(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("duration")).select("user_id", logs.pace(F.col("duration") / 5).alias("pace"))


QUERIES = {f.__name__: f for f in (paf_rows, paf_rows_without_number, anexos_rows, sem_anexos_rows, simple_notices, partial_export, partial_notices, batch_summary, multiple_invoices, due_flags, kind_shares, document_union, extractor_usage, extractors_of_batches, slowest_batches, validation_totals, session_totals, run_totals,
                                   ingestion_totals, case_filter, csv_quality, unseen_files, common_files, merged_labels, mail_headers, mail_numbers, mail_bodies, native_texts, exported_batches, diagnostics_by_file, report_totals, path_order, inherit_all, status_texts, problem_samples, batch_pace)}
_SHEET = """s AS (SELECT o_orderkey AS k, o_orderkey % 5 AS t, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.example/' || repeat('y', CAST(o_orderkey % 90 AS INTEGER)) END AS link FROM orders)"""
_BR = "strftime({}, '%d/%m/%Y')"
_F = lambda name, every: f"CASE WHEN k % {every} <> 0 THEN '{name}' || k ELSE '' END"
_REF = f"CASE WHEN k % 2 <> 0 THEN 'R' || k ELSE {_F('D', 3)} END"
_DUE = "CASE WHEN k % 3 <> 0 THEN " + _BR.format("day + 9") + " ELSE '' END"
_VALUE = "CASE t WHEN 4 THEN 0.0 WHEN 2 THEN CASE WHEN k % 8 <> 0 THEN v ELSE 0.0 END ELSE v END"
_STATE = "nullif([" + ", ".join(f"'{x}'" for x in STATES) + "][k // 5 % 3 + 1], '')"
_DOCS = """d AS (SELECT l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS doc_seq, ['NFSE', 'DANFE', 'BOLETO', 'OUTRO', 'AVISO'][l_partkey % 5 + 1] AS doc_type, CASE WHEN l_partkey % 3 <> 0 THEN 'S' || l_suppkey END AS fornecedor_nome,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS vencimento, CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey AS VARCHAR) END AS numero_nota, CASE WHEN l_partkey % 7 = 0 THEN 'P' || l_partkey END AS numero_pedido, CASE WHEN l_partkey % 6 <> 0 THEN round(l_extendedprice, 2) ELSE 0.0 END AS valor FROM lineitem)"""


def _first(value, order, keep):
    rank = "CASE doc_type " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(order)) + " END"
    return f"arg_min({value}, ({rank}, doc_seq)) FILTER ({keep} AND doc_type <> 'AVISO')"


_NUMBER = "CASE WHEN doc_type IN ('NFSE', 'DANFE') THEN CASE WHEN numero_nota IS NOT NULL THEN CASE doc_type WHEN 'NFSE' THEN 0 ELSE 1 END WHEN numero_pedido IS NOT NULL THEN CASE doc_type WHEN 'NFSE' THEN 2 ELSE 3 END END WHEN numero_nota IS NOT NULL THEN CASE doc_type WHEN 'OUTRO' THEN 4 WHEN 'BOLETO' THEN 5 END END"
_LOG = "e AS (SELECT event_id, user_id, ['Nfse', 'Boleto', 'Danfe'][event_id % 3 + 1] AS x, event_id % 5 < 2 AS tried, event_id % 5 IN (2, 3) AS answered, event_id % 2 = 0 AS yes FROM events)"
_ISSUE = "concat_ws(';', {})"
SQL = {
    "paf_rows": f"""WITH {_SHEET} SELECT k AS o_orderkey, {_BR.format('day')} AS DATA, '' AS SETOR, '' AS EMPRESA, {_F('F', 7)} AS FORNECEDOR, CASE WHEN t = 2 THEN {_REF} WHEN t = 3 THEN {_F('D', 3)} ELSE {_F('N', 4)} END AS NF, CASE WHEN t = 4 THEN '' ELSE {_BR.format('day - 1')} END AS EMISSAO, CAST({_VALUE} AS DOUBLE) AS VALOR,
  CASE WHEN t < 3 THEN {_F('P', 9)} ELSE '' END AS N_PEDIDO, {_DUE} AS VENCIMENTO, '' AS FORMA_PAGTO, '' AS INDICE, '' AS DT_CLASS, CASE WHEN t < 2 THEN {_F('T', 6)} WHEN t = 2 THEN {_REF} ELSE '' END AS N_FAT, CASE WHEN t = 1 THEN 'NF' ELSE 'FT' END AS TP_DOC, '' AS TRAT_PAF, '' AS LANC_SISTEMA,
  CASE WHEN k % 10 = 0 THEN 'visto' WHEN t = 4 THEN concat_ws(' | ', '[SEM ANEXO]', 'Link: ' || CASE WHEN length(link) > 80 THEN left(link, 77) || '...' ELSE link END, CASE WHEN k % 3 <> 0 THEN 'Código: C' || k END, CASE WHEN k % 4 <> 0 THEN 'NF: N' || k END) ELSE '' END AS OBSERVACOES, '' AS OBS_INTERNA FROM s""",
    "paf_rows_without_number": f"WITH {_SHEET} SELECT k AS o_orderkey, CASE t WHEN 3 THEN {_F('D', 3)} WHEN 4 THEN {_F('N', 4)} ELSE '' END AS NF, '' AS N_FAT FROM s",
    "anexos_rows": f"""WITH {_SHEET}, z AS (SELECT *, {_STATE} AS st, CASE WHEN k % 3 = 0 THEN 'CONFERIR' ELSE 'OK' END AS calc FROM s WHERE t < 4) SELECT k AS o_orderkey, {_BR.format('day')} AS PROCESSADO, {_BR.format('day')} AS RECEBIDO, {_F('Assunto ', 11)} AS ASSUNTO, '' AS N_PEDIDO, '' AS EMPRESA, {_DUE} AS VENCIMENTO, {_F('F', 7)} AS FORNECEDOR,
  CASE WHEN t < 2 THEN {_F('N', 4)} ELSE {_F('D', 3)} END AS NF, CAST({_VALUE} AS DOUBLE) AS VALOR, coalesce(st, calc) AS SITUACAO, concat_ws(' | ', '[' || coalesce(st, calc) || ']', CASE WHEN coalesce(st, calc) <> calc AND k % 3 = 0 THEN 'sem data' END, CASE WHEN k % 10 = 0 THEN 'visto' END) AS AVISOS FROM z""",
    "sem_anexos_rows": f"WITH {_SHEET} SELECT k AS o_orderkey, {_BR.format('day')} AS PROCESSADO, {_BR.format('day')} AS RECEBIDO, CASE WHEN k % 11 <> 0 THEN 'Assunto ' || k ELSE 'Completo' END AS ASSUNTO, '' AS N_PEDIDO, '' AS EMPRESA, {_F('F', 7)} AS FORNECEDOR, {_F('N', 4)} AS NF, coalesce(link, '') AS LINK, {_F('C', 3)} AS CODIGO FROM s WHERE t = 4",
    "simple_notices": f"WITH {_SHEET} SELECT CAST(k AS VARCHAR) AS email_id, CASE WHEN k % 11 <> 0 THEN 'Assunto ' || k END AS subject, CAST(NULL AS VARCHAR) AS sender_name, CAST(NULL AS VARCHAR) AS sender_address, CAST(NULL AS VARCHAR) AS received_date, link AS link_nfe, CASE WHEN k % 3 <> 0 THEN 'C' || k END AS codigo_verificacao, CAST(NULL AS VARCHAR) AS empresa, 'PENDENTE_DOWNLOAD' AS status FROM s WHERE t = 4",
    "partial_export": "SELECT l_linenumber AS numero, l_returnflag AS doc_type, 'b' || l_orderkey AS batch_id, CASE WHEN l_orderkey % 2 = 0 THEN 'Assunto' ELSE '' END AS email_subject FROM lineitem",
    "partial_notices": f"WITH {_SHEET} SELECT 'AVISO' AS tipo_documento, CAST(k AS VARCHAR) AS arquivo_origem, CAST(NULL AS VARCHAR) AS data_processamento, CAST(NULL AS VARCHAR) AS email_date, CAST(NULL AS VARCHAR) AS empresa, CASE WHEN k % 7 <> 0 THEN 'F' || k END AS fornecedor_nome, CASE WHEN k % 4 <> 0 THEN 'N' || k END AS numero_nota, link AS link_nfe, CAST(NULL AS VARCHAR) AS codigo_verificacao, CAST(NULL AS VARCHAR) AS dominio_portal, CASE WHEN k % 2 = 0 THEN 'Completo' WHEN k % 11 <> 0 THEN 'Assunto ' || k END AS email_subject, CAST(NULL AS VARCHAR) AS vencimento, CAST(NULL AS VARCHAR) AS observacoes, CAST(NULL AS VARCHAR) AS status_conciliacao FROM s WHERE t = 4",
    "batch_summary": f"""WITH {_DOCS}, x AS (SELECT *, {_NUMBER} AS place FROM d), g AS (SELECT batch_id, {_first('fornecedor_nome', ('NFSE', 'DANFE', 'OUTRO', 'BOLETO'), 'fornecedor_nome IS NOT NULL')} AS fornecedor, {_first('vencimento', ('NFSE', 'DANFE', 'BOLETO', 'OUTRO'), 'vencimento IS NOT NULL')} AS vencimento,
  coalesce({_first('valor', ('NFSE', 'DANFE', 'OUTRO', 'BOLETO'), 'valor > 0')}, 0.0) AS valor_compra, arg_min(CASE WHEN place IN (2, 3) THEN numero_pedido ELSE numero_nota END, (place, doc_seq)) FILTER (place IS NOT NULL) AS numero_nota, count(*) AS total_documents,
  count(*) FILTER (doc_type = 'DANFE') AS danfes, count(*) FILTER (doc_type = 'BOLETO') AS boletos, count(*) FILTER (doc_type = 'NFSE') AS nfses, count(*) FILTER (doc_type = 'OUTRO') AS outros, count(*) FILTER (doc_type = 'AVISO') AS avisos, CAST(sum(CASE WHEN doc_type = 'BOLETO' THEN CAST(valor AS DECIMAL(20, 4)) ELSE 0 END) AS DOUBLE) AS valor_boleto FROM x GROUP BY batch_id)
SELECT o_orderkey AS batch_id, '/in/' || o_orderkey AS source_folder, o_orderpriority AS email_subject, o_orderstatus AS email_sender, CAST(o_orderkey % 3 AS INTEGER) AS total_errors, fornecedor, vencimento, numero_nota, coalesce(total_documents, 0) AS total_documents, coalesce(danfes, 0) AS danfes, coalesce(boletos, 0) AS boletos, coalesce(nfses, 0) AS nfses, coalesce(outros, 0) AS outros, coalesce(avisos, 0) AS avisos, CAST(coalesce(valor_boleto, 0) AS DOUBLE) AS valor_boleto, CAST(coalesce(valor_compra, 0) AS DOUBLE) AS valor_compra
FROM orders LEFT JOIN g ON g.batch_id = o_orderkey""",
    "multiple_invoices": f"WITH {_DOCS} SELECT batch_id, count(*) FILTER (doc_type IN ('NFSE', 'DANFE') OR (doc_type = 'OUTRO' AND valor > 0)) > 1 AS multiple FROM d GROUP BY batch_id",
    "due_flags": f"WITH {_DOCS}, f AS (SELECT *, count(vencimento) OVER (PARTITION BY batch_id) = 0 AS sem_vencimento FROM d) SELECT batch_id, doc_seq, sem_vencimento, nullif(concat_ws(' ', CASE WHEN doc_type = 'BOLETO' THEN 'dif' END, CASE WHEN doc_type = 'OUTRO' THEN '{runs.GENERIC_VALUE}' END, CASE WHEN sem_vencimento THEN '{runs.NO_DUE}' END), '') AS divergencia FROM f",
    "kind_shares": f"WITH {_DOCS} SELECT doc_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM d GROUP BY doc_type",
    "document_union": f"""WITH {_DOCS}, x AS (SELECT * FROM d WHERE doc_type = 'NFSE'), p AS (SELECT d.* FROM d WHERE doc_type = 'BOLETO' OR (doc_type = 'DANFE' AND NOT EXISTS (SELECT 1 FROM x WHERE x.batch_id = d.batch_id AND x.numero_nota = d.numero_nota))), a AS (SELECT * FROM x UNION ALL SELECT * FROM p)
SELECT batch_id, doc_seq, doc_type FROM a UNION ALL SELECT batch_id, doc_seq, doc_type FROM d WHERE doc_type IN ('OUTRO', 'AVISO') AND batch_id NOT IN (SELECT batch_id FROM a WHERE fornecedor_nome IS NOT NULL OR valor > 0)""",
    "extractor_usage": f"WITH {_LOG} SELECT x AS extractor, count(*) FILTER (tried) AS used, count(*) FILTER (answered AND yes) AS succeeded, count(*) FILTER (answered AND NOT yes) AS failed FROM e WHERE tried OR answered GROUP BY x",
    "extractors_of_batches": f"WITH {_LOG} SELECT user_id AS batch, coalesce(string_agg(DISTINCT x, ',' ORDER BY x) FILTER (tried), '') AS tried, arg_max(x, event_id) FILTER (answered AND yes) AS used, count(*) FILTER (NOT tried AND NOT answered) AS unmatched FROM e GROUP BY user_id",
    "slowest_batches": "SELECT user_id, max(value) AS duration FROM events GROUP BY user_id ORDER BY duration DESC, user_id LIMIT 5",
    "validation_totals": f"WITH {_DOCS} SELECT doc_type, count(*) FILTER (valor > 0) AS succeeded, count(*) FILTER (NOT valor > 0) AS failed, round(100.0 * count(*) FILTER (valor > 0) / count(*), 1) AS success_rate FROM d GROUP BY doc_type",
    "session_totals": "SELECT CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS emails_scanned, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS emails_processed, 0.0::DOUBLE AS emails_skipped, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS emails_errors, 0.0::DOUBLE AS batches_created, 0.0::DOUBLE AS batches_processed, 0.0::DOUBLE AS documents_extracted, 0.0::DOUBLE AS avisos_created FROM events",
    "run_totals": "SELECT count(*) AS batches, CAST(sum(o_custkey) AS BIGINT) AS documents, CAST(sum(o_orderkey % 2) AS BIGINT) AS errors, CAST(sum(CAST(round(o_totalprice, 2) AS DECIMAL(20, 4))) AS DOUBLE) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS n_ok, count(*) FILTER (o_orderkey % 3 = 1) AS n_timeout, count(*) FILTER (o_orderkey % 3 = 2) AS n_error FROM orders",
    "ingestion_totals": "SELECT count(*) AS scanned, count(*) FILTER (page_id % 3 = 0) AS with_attachments, count(*) FILTER (page_id % 3 <> 0) AS without_attachments, count(*) FILTER (page_id % 4 = 0) AS filtered_out, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM customer) AS notices FROM pages",
    "case_filter": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_orderkey % 2 = 0 AND o_orderkey BETWEEN 10 AND 100000",
    "csv_quality": f"""WITH q AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS missing, o_orderkey % 3 AS others, o_orderkey % 2 AS notes, o_orderkey % 4 AS s FROM orders), z AS (SELECT *, missing AND others > 0 AND notes = 0 AS no_due FROM q)
SELECT k AS o_orderkey, CASE WHEN k % 5 = 0 THEN 'curto' ELSE '' END AS supplier, {_ISSUE.format("CASE k % 7 WHEN 0 THEN 'ZERADO' WHEN 1 THEN 'FORMATO' END, CASE WHEN no_due THEN CASE WHEN s IN (0, 2) THEN 'Vencimento não extraído (assunto sugere boleto/fatura)' ELSE 'Vencimento não extraído (pode ser boleto)' END END")} AS due,
  CASE WHEN k % 2 = 0 AND (others > 0 OR notes > 0) THEN 'Valor zero com ' || others || ' outros e ' || notes || ' NFSEs' ELSE '' END AS value, CASE WHEN notes > 0 AND k % 6 = 0 THEN 'Número da nota não extraído (para NFSE)' ELSE '' END AS number, CASE s WHEN 0 THEN 'Assunto sugere boleto/fatura' WHEN 1 THEN 'Assunto sugere nota fiscal' ELSE '' END AS kind,
  {_ISSUE.format("CASE WHEN k % 7 = 0 THEN 'Data zerada ou inválida' WHEN k % 7 = 1 AND NOT missing THEN 'Data de vencimento inválida' END, CASE WHEN no_due THEN 'Data de vencimento faltante' END")} AS dates FROM z""",
    "unseen_files": "SELECT source || '/' || doc_id AS path FROM documents WHERE NOT (source = 'web' AND doc_id IN (SELECT doc_id FROM labels))",
    "common_files": "WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS a, list(DISTINCT CAST(l_linenumber AS BIGINT)) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS common FROM g",
    "merged_labels": "SELECT event_id, 'type=' || event_type || ',u=' || (user_id % 3) || ',z=1' AS labels FROM events",
    "mail_numbers": NUMBERS_SQL,
    "mail_headers": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Nota Fiscal é ' || o_orderkey WHEN 1 THEN 'Fatura ' || o_orderkey ELSE 'é ' || o_orderkey END AS subject, CASE o_orderkey % 5 WHEN 0 THEN 'Loja ' || o_orderkey WHEN 2 THEN 'A <B> C' ELSE '' END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'loja' || o_orderkey || '@x.com' WHEN 1 THEN o_orderkey || '@y.com' WHEN 2 THEN 'c' || o_orderkey || '@z.com' WHEN 3 THEN 'so@w.com' ELSE '' END AS address, CASE WHEN o_orderkey % 2 = 1 THEN DATE '2025-12-02' WHEN o_orderkey % 4 = 0 THEN DATE '2025-12-24' ELSE DATE '2020-01-01' END AS day FROM orders""",
    "mail_bodies": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'texto ' || page_id ELSE '' END AS plain, CAST(CASE WHEN page_id % 2 = 0 THEN length(trim(html)) ELSE 0 END AS INTEGER) AS html_length FROM pages",
    "native_texts": "SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN CASE WHEN length(trim(text)) + 1 > 300 THEN length(text) + 1 ELSE 200 END WHEN length(trim(text)) < 50 THEN 0 ELSE length(text) END AS INTEGER) AS n FROM documents",
    "exported_batches": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2025-06-01' END AS data_processamento, 'F' || o_orderkey AS fornecedor_nome, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS numero_documento, CASE WHEN o_orderkey % 5 = 0 THEN 7.5 ELSE round(o_totalprice, 2) END AS valor_total, nullif(concat_ws(' | ', CASE WHEN o_orderkey % 4 = 0 THEN '[CONFERIR]' END, CASE WHEN o_orderkey % 6 = 0 THEN 'dif 1' END), '') AS observacoes FROM orders",
    "diagnostics_by_file": "SELECT CASE WHEN user_id % 5 <> 0 THEN 'f' || (user_id % 7) ELSE 'unknown' END AS file, CASE WHEN event_type <> 'view' THEN event_type ELSE 'information' END AS severity, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS first FROM events WHERE event_id % 10 < 3 GROUP BY 1, 2",
    "report_totals": "WITH c AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders) SELECT count(*) AS total_cases, count(*) FILTER (k % 2 = 0) AS issue_value, 0::BIGINT AS issue_vencimento, count(*) FILTER (k % 2 = 1) AS issue_fornecedor, 0::BIGINT AS issue_numero_nota, 0::BIGINT AS issue_extractor_identification, 0::BIGINT AS issue_data_validation, count(*) FILTER (k % 3 = 0) AS severity_alta, count(*) FILTER (k % 3 = 1) AS severity_media, 0::BIGINT AS severity_baixa, count(*) FILTER (k % 4 = 0) AS classification_unknown, count(*) FILTER (k % 4 = 1) AS classification_nfse, count(*) FILTER (k % 4 = 3) AS classification_administrativos, count(*) FILTER (k % 4 = 2) AS classification_boleto, 0::BIGINT AS action_investigar_manualmente, count(*) FILTER (k % 5 = 0) AS action_melhorar_extracao, 0::BIGINT AS action_corrigir_valores FROM c",
    "path_order": "WITH p AS (SELECT l_orderkey, 'p' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '_' || l_linenumber || '_' || l_partkey AS path FROM lineitem) SELECT l_orderkey, path, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY path) AS INTEGER) AS doc_seq FROM p",
    "inherit_all": f"""WITH {_DOCS}, x AS (SELECT * FROM d WHERE doc_type <> 'AVISO'), g AS (SELECT batch_id, arg_min(numero_nota, (CASE doc_type WHEN 'DANFE' THEN 0 WHEN 'NFSE' THEN 1 ELSE 2 END, doc_seq)) FILTER (doc_type <> 'BOLETO' AND numero_nota IS NOT NULL) AS ref, arg_min(vencimento, doc_seq) FILTER (doc_type = 'BOLETO' AND vencimento IS NOT NULL) AS due,
  count(*) FILTER (doc_type IN ('DANFE', 'NFSE')) > 0 AS notes, arg_min(CASE WHEN doc_type = 'OUTRO' THEN numero_nota ELSE numero_pedido END, doc_seq) FILTER (CASE WHEN doc_type = 'OUTRO' THEN numero_nota ELSE numero_pedido END IS NOT NULL) AS pedido, count(numero_nota) + count(numero_pedido) FILTER (doc_type IN ('DANFE', 'NFSE')) = 0 AS no_number FROM x GROUP BY batch_id)
SELECT x.batch_id, doc_seq, doc_type, coalesce(numero_nota, CASE WHEN doc_type = 'OUTRO' THEN pedido END, CASE WHEN no_number AND x.batch_id % 3 = 0 THEN 'E1' END) AS numero, CASE WHEN doc_type = 'OUTRO' THEN numero_pedido ELSE coalesce(numero_pedido, pedido) END AS numero_pedido,
  CASE WHEN valor = 0 THEN 'R' WHEN doc_type = 'BOLETO' THEN ref END AS referencia_nfse, coalesce(vencimento, CASE WHEN doc_type IN ('DANFE', 'NFSE') THEN due END, CASE WHEN NOT (due IS NOT NULL AND notes) AND x.batch_id % 3 = 0 THEN DATE '2030-01-01' END) AS vencimento FROM x JOIN g ON x.batch_id = g.batch_id""",
    "status_texts": """WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS v, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END WHEN 1 THEN round(o_totalprice, 2) + 5 ELSE 0.0 END AS s FROM orders),
z AS (SELECT *, CASE WHEN v > 0 AND s > 0 THEN CASE WHEN k % 3 = 0 THEN 'CONCILIADO' ELSE 'DIVERGENTE' END ELSE 'CONFERIR' END AS status, CASE k % 7 WHEN 0 THEN 'ENCAMINHAMENTO DUPLICADO - notas: 1, 2' WHEN 1 THEN 'ENCAMINHAMENTO DUPLICADO - mesmos valores detectados' END AS twice FROM q)
SELECT k AS o_orderkey, status, nullif(concat_ws(' ', CASE status WHEN 'CONCILIADO' THEN twice WHEN 'DIVERGENTE' THEN printf('Valor compra: R$ %.2f | Valor boleto: R$ %.2f | Diferença: R$ %.2f', v, s, v - s) ELSE CASE WHEN s > 0 THEN printf('Conferir boleto (R$ %.2f) - NF sem valor encontrada', s) ELSE printf('Conferir valor (R$ %.2f) - sem boleto para comparação', v) END END,
  CASE WHEN status <> 'CONCILIADO' THEN '[' || twice || ']' END, CASE WHEN k % 11 = 0 THEN '[POSSÍVEL DOCUMENTO ADMINISTRATIVO - Distrato]' END, CASE WHEN k % 13 = 0 THEN '[VALOR EXTRAÍDO DE DOCUMENTO GENÉRICO - conferir manualmente]' END), '') AS text FROM z""",
    "problem_samples": PROBLEM_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY p.kind ORDER BY o_orderkey) AS i FROM p WHERE p.severity >= 0.5) SELECT p.kind AS kind, CAST(max(p.severity) AS DOUBLE) AS max_severity, count(*) AS n, CAST(sum(CAST(note AS DECIMAL(18, 2))) AS DOUBLE) AS total, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (i <= 3) AS samples FROM r GROUP BY p.kind",
    "batch_pace": "SELECT user_id, CASE WHEN max(value) / 5 > 20 THEN 'SLOW' WHEN max(value) / 5 > 5 THEN 'WARNING' ELSE 'OK' END AS pace FROM events GROUP BY user_id",
}
