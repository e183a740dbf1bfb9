"""Queries over mail context, readers, dimensions and success codes."""

from pyspark.sql import functions as F

from ..functions import ids, money, names
from ..functions.fixed import PAYMENT
from ..operators import batches, context, export
from ..sources.tables import table


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


SUBJECTS = ("Distrato do contrato", "Lembrete gentil - fatura", "Nota Fiscal 5", "Sua ordem foi agendada", "Guia - processo 12", "Anuidade CREA", None)
NAMES = ("Documento de distrato", "Lembrete administrativo", None, "Ordem de serviço/agendamento", "Guia jurídica/fiscal", "Taxa/anuidade de órgão", None)


def admin_subjects(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", context.admin_subject(_pick(SUBJECTS, F.col("o_orderkey"))).alias("kind"))


FILES = ("demonstrativo_1.pdf", "nf_2.pdf", "recibo 3.pdf", "Atestado.pdf")


def auxiliary_documents(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.lit("Declaramos que")).otherwise(F.lit("Nota"))
    return o.select("o_orderkey", context.auxiliary(text, F.lit(None).cast("string"), F.when(k % 3 == 0, F.col("o_totalprice")), _pick(FILES, k)).alias("auxiliary"))


def reader_choice(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents")
    native = F.when(F.col("doc_id") % 3 != 0, t)
    out = context.best_text(native, F.when(F.col("doc_id") % 3 == 0, F.left(t, F.lit(300))), F.lit("digitalizado " * 5))
    return docs.select("doc_id", context.looks_incomplete(native).alias("incomplete"), F.length(out).alias("n"))


def table_cells(spark, d):
    s = table(spark, d, "supplier")
    header, row = F.array(F.lit("Nome"), F.lit("Vazio"), F.lit("Chave")), F.array(F.col("s_name"), F.lit(" "), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", F.array_join(context.table_lines(header, row), "\n").alias("lines"))


def password_candidates(spark, d):
    return context.password_candidates(table(spark, d, "supplier").select(F.lpad((F.col("s_suppkey") * 7919).cast("string"), 14, "4").alias("cnpj")), "cnpj")


def payment_codes(spark, d):
    o = table(spark, d, "orders")
    code = F.lpad((F.col("o_orderkey") % 23).cast("string"), 2, "0")
    return o.select("o_orderkey", context.payment_name(code).alias("forma"))


def success_codes(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    number, amount = F.when(k % 4 != 0, k.cast("string")), F.when(k % 5 != 0, F.col("o_totalprice")).otherwise(0.0)
    miss = context.missing_fields(F.when(k % 7 != 0, F.lit("X")), F.when(k % 3 != 0, F.col("o_orderdate").cast("date")), number, amount)
    guess = context.failure_guess(F.when(k % 11 == 0, F.lit("Boleto.pdf")).otherwise(F.lit("nf.pdf")), F.when(k % 13 == 0, F.lit("LOCAÇÃO")), number, amount)
    return o.select("o_orderkey", F.array_join(miss, ",").alias("missing"), (F.size(miss) == 0).alias("complete"), guess.alias("guess"))


def mail_body(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("v"))
    body = F.concat(F.lit("Segue a nota fiscal nº "), (F.col("o_orderkey") + 10).cast("string"), F.lit("\nTotal: R$ "), money.render_br(F.col("v")), F.lit("\nVencimento: 10/05\nAcesse https://x.com/n?nf="), F.col("o_orderkey").cast("string"), F.lit(" codigo: AB-12345"))
    b = o.select("o_orderkey", context.body_fields(body, F.lit("1998-03-01").cast("date")).alias("b"))
    return b.select("o_orderkey", "b.valor", "b.confianca", "b.vencimento", "b.numero", "b.codigo", context.sheet_number_of(F.col("b.link")).alias("link_number"))


def _companies(spark, d):
    s = table(spark, d, "supplier")
    return s.where("s_suppkey % 2 = 0").select(F.lpad((F.col("s_suppkey") + 1).cast("string"), 14, "0").alias("cnpj"), F.concat(F.lit("E"), "s_suppkey").alias("code"))


def _company_texts(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("s"))
    return li.select("l_orderkey", F.array_join(F.transform("s", lambda x: ids.format_cnpj(F.lpad((x + 1).cast("string"), 14, "0"))), " e ").alias("text"))


def company_lookup(spark, d):
    docs, companies = _company_texts(spark, d), _companies(spark, d)
    return context.company_of(docs, companies, "l_orderkey", "text").join(context.foreign_cnpj(docs, companies, "l_orderkey", "text"), "l_orderkey", "left")


def split_names(spark, d):
    words = ("BRASIL", "AUDITORIA", "E", "CONSULTORIA", "LTDA", "RSM")
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", names.split_name(F.lit("RSMBRASILAUDITORIAECONSULTORIALTDA"), words[:2] + words[3:]).alias("name"), names.split_name(F.col("s_name"), words).alias("same"))


def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    twice = e.withColumn("version", F.lit(1)).unionByName(e.where("vec_id % 2 = 0").withColumn("version", F.lit(2)))
    return context.latest(twice, "vec_id", F.col("version")).select(F.md5(F.concat_ws("::", F.lit("embeddings"), F.col("vec_id").cast("string"))).alias("key"), "version")


def report_split(spark, d):
    o = table(spark, d, "orders")
    case = F.concat(F.lit("Batch: b"), "o_orderkey", F.lit("\nValor: "), F.format_string("%.2f", "o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("\nSEM VENCIMENTO")).otherwise(F.lit("")), F.lit("\n"))
    return context.report_cases(o.select(F.concat(case, F.lit("-" * 80), F.lit("\n")).alias("text")), "text")


def prometheus_lines(spark, d):
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("u")).agg(F.count("*").alias("value"))
    return context.prometheus(e.select(F.lit("events_total").alias("name"), F.create_map(F.lit("u"), F.col("u").cast("string"), F.lit("type"), F.col("event_type")).alias("labels"), "value"))


def sink_chunks(spark, d):
    return export.in_chunks(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


def retention(spark, d):
    o = table(spark, d, "orders")
    return batches.retained(o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("made")), "made", F.lit("1998-01-03 00:00:00").cast("timestamp")).select("o_orderkey")


QUERIES = {f.__name__: f for f in (admin_subjects, auxiliary_documents, reader_choice, table_cells, password_candidates, payment_codes, success_codes, mail_body, company_lookup, split_names, vector_upsert, report_split, prometheus_lines, sink_chunks, retention)}
_DAYS, _SUMS = r"len(regexp_extract_all({v}, '\b\d{{2}}\s*/\s*\d{{2}}\s*/\s*\d{{4}}\b'))", r"len(regexp_extract_all({v}, '\b\d{{1,3}}(?:\s*\.\s*\d{{3}})*\s*,\s*\d{{2}}\b'))"
_MARK = r"(regexp_matches({v}, '\b\d{{2}}\s*\.\s*\d{{3}}\s*\.\s*\d{{3}}\s*/\s*\d{{4}}\s*-\s*\d{{2}}\b') OR regexp_matches({v}, '\d{{5}}[.\s]\d{{5}}\s+\d{{5}}[.\s]\d{{6}}\s+\d{{5}}[.\s]\d{{6}}'))"
_INCOMPLETE = f"(length({{v}}) < 200 OR ({_MARK} AND ({_DAYS} < 1 OR {_SUMS} < 1)) OR (length({{v}}) < 600 AND ({_DAYS} < 2 OR {_SUMS} < 1)))"
READER_SQL = r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text END AS native, CASE WHEN doc_id % 3 = 0 THEN left(text, 300) END AS tab FROM documents),
c AS (SELECT doc_id, coalesce(native, '') AS x, CASE WHEN length(native) >= 50 THEN native WHEN length(tab) >= 50 THEN tab END AS pick FROM t),
f AS (SELECT doc_id, pick, trim(regexp_replace(x, '\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(pick, ''), '\s+', ' ', 'g')) AS b FROM c)
SELECT doc_id, """ + _INCOMPLETE.format(v="a") + " AS incomplete, CAST(CASE WHEN pick IS NULL THEN 65 WHEN " + _INCOMPLETE.format(v="b") + " THEN length(pick) + 66 ELSE length(pick) END AS INTEGER) AS n FROM f"
_PAY = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAYMENT.items()) + " ELSE 'CODIGO_' || c END"
SQL = {
    "admin_subjects": f"SELECT o_orderkey, {_sql_list(NAMES)}[o_orderkey % 7 + 1] AS kind FROM orders",
    "auxiliary_documents": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 3 = 0 AND o_totalprice > 0 THEN false ELSE o_orderkey % 4 <> 1 END AS auxiliary FROM orders",
    "reader_choice": READER_SQL,
    "table_cells": "SELECT s_suppkey, 'Nome: ' || s_name || chr(10) || 'Chave: ' || s_suppkey AS lines FROM supplier",
    "password_candidates": "WITH c AS (SELECT lpad(CAST(s_suppkey * 7919 AS VARCHAR), 14, '4') AS d FROM supplier) SELECT DISTINCT unnest([d, left(d, 4), left(d, 5), left(d, 8)]) AS candidate FROM c",
    "payment_codes": f"SELECT o_orderkey, {_PAY} AS forma FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 23 AS VARCHAR), 2, '0') AS c FROM orders)",
    "success_codes": "WITH m AS (SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'fornecedor_nome' END, CASE WHEN o_orderkey % 3 = 0 THEN 'vencimento' END, CASE WHEN o_orderkey % 4 = 0 THEN 'numero_nota' END, CASE WHEN o_orderkey % 5 = 0 OR o_totalprice <= 0 THEN 'valor_total' END) AS missing, o_totalprice FROM orders) SELECT k AS o_orderkey, missing, missing = '' AS complete, CASE WHEN k % 11 = 0 THEN 'BOLETO/RECIBO (Ignorar se não for NF).' WHEN k % 13 = 0 THEN 'LOCAÇÃO (Layout atípico).' WHEN k % 5 = 0 OR o_totalprice <= 0 THEN 'Regex de VALOR falhou.' WHEN k % 4 = 0 THEN 'Regex de NÚMERO DA NOTA falhou.' ELSE 'Falha genérica de extração.' END AS guess FROM m",
    "mail_body": "SELECT o_orderkey, round(o_totalprice, 2) AS valor, 0.8 AS confianca, DATE '1998-05-10' AS vencimento, CAST(o_orderkey + 10 AS VARCHAR) AS numero, 'AB-12345' AS codigo, CAST(o_orderkey AS VARCHAR) AS link_number FROM orders",
    "company_lookup": "WITH n AS (SELECT l_orderkey, l_suppkey, count(*) AS t FROM lineitem GROUP BY 1, 2), e AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY t DESC, l_suppkey) AS i FROM n WHERE l_suppkey % 2 = 0), f AS (SELECT l_orderkey, min(l_suppkey) AS s FROM n WHERE l_suppkey % 2 = 1 GROUP BY 1) SELECT o.l_orderkey, CASE WHEN e.l_suppkey IS NOT NULL THEN 'E' || e.l_suppkey END AS empresa, CASE WHEN f.s IS NOT NULL THEN lpad(CAST(f.s + 1 AS VARCHAR), 14, '0') END AS cnpj FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN e ON e.l_orderkey = o.l_orderkey AND e.i = 1 LEFT JOIN f ON f.l_orderkey = o.l_orderkey",
    "split_names": "SELECT s_suppkey, 'RSM BRASIL AUDITORIA E CONSULTORIA LTDA' AS name, s_name AS same FROM supplier",
    "vector_upsert": "SELECT md5('embeddings::' || vec_id) AS key, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM embeddings",
    "report_split": "SELECT 'b' || o_orderkey AS batch, printf('%.2f', o_totalprice) AS valor, o_orderkey % 2 = 0 AS no_due FROM orders",
    "prometheus_lines": """SELECT 'events_total{type="' || event_type || '",u="' || (user_id % 2) || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 2""",
    "sink_chunks": "WITH n AS (SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS chunk FROM supplier) SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(s_suppkey) AS first FROM n GROUP BY chunk",
    "retention": "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
}
