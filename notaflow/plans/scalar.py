"""Queries over scalar functions. Input texts are rendered from the driver tables' numbers, as those hold no invoices."""

from pyspark.sql import functions as F

from ..functions import dates, ids, money, names, text, workdays
from ..functions.fixed import BANKS
from ..operators import export
from ..sources.tables import table

ORDER_DAY = "CAST(o_orderdate AS DATE)"


def rendered(spark, d):
    o = table(spark, d, "orders")
    cents = F.pmod(F.col("o_orderkey"), F.lit(97)) + 1
    price, other = F.round(F.col("o_totalprice"), 2), F.round(cents / 4.0, 2)
    return o.select("o_orderkey", price.alias("price"), other.alias("other"), F.concat(F.lit("Total: R$ "), money.render_br(price), F.lit(" + R$ "), money.render_br(other), F.lit(" em 2 vezes")).alias("line"))


SQL_AMOUNT = r"""regexp_extract_all(line, '\b(\d{1,3}(?:\.\d{3})*,\d{2})\b', 1)"""
SQL_BR = "replace(replace(replace({x}, ',', '#'), '.', ','), '#', '.')"
SQL_RENDERED = """SELECT o_orderkey, round(o_totalprice, 2) AS price, round((o_orderkey % 97 + 1) / 4.0, 2) AS other,
  'Total: R$ ' || replace(replace(replace(format('{:,.2f}', CAST(round(o_totalprice, 2) AS DOUBLE)), ',', '#'), '.', ','), '#', '.') || ' + R$ ' ||
  replace(replace(replace(format('{:,.2f}', CAST(round((o_orderkey % 97 + 1) / 4.0, 2) AS DOUBLE)), ',', '#'), '.', ','), '#', '.') || ' em 2 vezes' AS line FROM orders"""
SQL_PARSE = "coalesce(TRY_CAST(replace(replace({x}, '.', ''), ',', '.') AS DOUBLE), 0)"


def money_parse(spark, d):
    r = rendered(spark, d)
    return r.select("o_orderkey", money.parse_br(money.render_br(F.col("price"))).alias("parsed"), money.parse_br(F.lit("sem valor")).alias("bad"),
                    money.sheet_number(F.col("price").cast("string")).alias("sheet"), money.xml_number(money.render_br(F.col("other"))).alias("xml"))


def money_extract(spark, d):
    r = rendered(spark, d)
    return r.select("o_orderkey", F.array_join(F.transform(money.amounts(F.col("line")), lambda x: F.format_string("%.2f", x)), "|").alias("amounts"), money.largest(F.col("line")).alias("largest"))


def slip_line_fields(spark, d):
    o = table(spark, d, "orders")
    digits = F.concat(F.lpad((F.col("o_orderkey") * 7919 % 10**9).cast("string"), 33, "1"), F.lpad((F.col("o_orderkey") * 31 % 9000 + 1000).cast("string"), 4, "0"), F.lpad(F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), 10, "0"))
    code = F.element_at(F.array(*map(F.lit, [*BANKS, "999"])), (F.col("o_orderkey") % 21 + 1).cast("int"))
    x = o.select("o_orderkey", digits.alias("line"), code.alias("code"))
    names = F.create_map(*[F.lit(v) for kv in BANKS.items() for v in kv])
    return x.select("o_orderkey", money.of_slip_line(F.col("line")).alias("amount"), dates.factor_of_line(F.col("line")).alias("factor"),
                    dates.due_from_factor(dates.factor_of_line(F.col("line"))).alias("due"), dates.due_from_factor(dates.factor_of_line(F.col("line")), "febraban").alias("due_febraban"),
                    F.coalesce(F.try_element_at(names, "code"), F.concat(F.lit("BANCO_"), "code")).alias("bank"),
                    ids.slip_line(F.concat(F.lit("Linha: "), "line", F.lit(" fim"))).alias("found"))


_BANK_SQL = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BANKS.items()) + " ELSE 'BANCO_' || code END"
_CODES_SQL = "[" + ", ".join(f"'{k}'" for k in [*BANKS, "999"]) + "]"
SLIP_SQL = f"""WITH x AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 33, '1') || lpad(CAST(o_orderkey * 31 % 9000 + 1000 AS VARCHAR), 4, '0') || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 10, '0') AS line,
  {_CODES_SQL}[o_orderkey % 21 + 1] AS code FROM orders),
y AS (SELECT *, CAST(substr(line, 34, 4) AS INTEGER) AS factor FROM x),
z AS (SELECT *, DATE '1997-10-07' + factor AS d0 FROM y),
w AS (SELECT *, CASE WHEN year(d0) < 2020 THEN d0 + 10000 ELSE d0 END AS d1, CASE WHEN year(d0) < 2020 THEN d0 + 9000 ELSE d0 END AS d2 FROM z)
SELECT o_orderkey, CAST(right(line, 10) AS BIGINT) / 100.0 AS amount, factor, CASE WHEN year(d1) BETWEEN 2020 AND 2045 THEN CAST(d1 AS DATE) END AS due,
  CASE WHEN year(d2) BETWEEN 2020 AND 2045 THEN CAST(d2 AS DATE) END AS due_febraban, {_BANK_SQL} AS bank, line AS found FROM w"""


def date_parse_br(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.pmod("o_orderkey", F.lit(5))
    s = F.when(k == 0, F.date_format("day", "dd/MM/yyyy")).when(k == 1, F.date_format("day", "dd-MM-yy")).when(k == 2, F.date_format("day", "d.M.yyyy")).when(k == 3, F.lit("31/02/2001")).otherwise(F.concat(F.lit("x"), F.date_format("day", "dd/MM/yyyy")))
    o = o.withColumn("s", s)
    return o.select("o_orderkey", "s", dates.parse_br(F.col("s")).alias("parsed"), dates.first_br(F.concat(F.lit("Emitido em "), "s", F.lit(" na cidade"))).alias("first"),
                    dates.iso_or_same(F.col("s")).alias("iso"), dates.xml_date(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T10:00:00-03:00"))).alias("xml"),
                    dates.header_date(F.concat(F.lit("Mon, "), F.date_format("day", "d MMM yyyy"), F.lit(" 10:00:00 -0300"))).alias("header"))


DATE_SQL = r"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN strftime(day, '%d/%m/%Y') WHEN 1 THEN strftime(day, '%d-%m-%y') WHEN 2 THEN strftime(day, '%-d.%-m.%Y') WHEN 3 THEN '31/02/2001' ELSE 'x' || strftime(day, '%d/%m/%Y') END AS s FROM o)
SELECT o_orderkey, s, CASE WHEN o_orderkey % 5 < 3 THEN day END AS parsed, CASE WHEN o_orderkey % 5 < 2 THEN day END AS first,
  CASE WHEN regexp_full_match(s, '\d{1,2}/\d{1,2}/\d{4}') THEN substr(s, 7, 4) || '-' || substr(s, 4, 2) || '-' || substr(s, 1, 2) ELSE s END AS iso, day AS xml, day AS header FROM s"""


def id_extract(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    n = F.lpad((F.col("o_orderkey") * 104729 % 10**14).cast("string"), 14, "0")
    t = F.concat(F.lit("Emitente CNPJ "), ids.format_cnpj(n), F.lit(" chave "), n, n, n, F.lit("99 CPF 123.456.789-09 mail a@x"), F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit(".com.br Pedido: "), F.col("o_orderkey").cast("string"))
    o = o.withColumn("n", n).withColumn("t", t)
    c = F.col("t")
    return o.select("o_orderkey", ids.cnpj(c).alias("cnpj"), ids.cpf(c).alias("cpf"), ids.flexible_cnpj(F.concat(F.lit("CNPJ "), "n")).alias("flexible"), ids.cnpj_digits(ids.cnpj(c)).alias("digits"),
                    ids.is_cnpj(ids.cnpj(c)).alias("valid"), F.array_join(ids.all_cnpjs(c), "|").alias("every"), F.array_join(ids.domains(c), "|").alias("domains"), ids.order_number(c).alias("pedido"),
                    ids.access_key(F.concat(F.lit("chave "), "n", "n", "n", F.lit("99"))).alias("chave"))


ID_SQL = r"""WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 104729 % 100000000000000 AS VARCHAR), 14, '0') AS n FROM orders),
c AS (SELECT *, substr(n, 1, 2) || '.' || substr(n, 3, 3) || '.' || substr(n, 6, 3) || '/' || substr(n, 9, 4) || '-' || substr(n, 13, 2) AS c FROM o)
SELECT o_orderkey, c AS cnpj, '123.456.789-09' AS cpf, c AS flexible, n AS digits, true AS valid, n AS every, 'x' || (o_orderkey % 7) || '.com.br' AS domains, CAST(o_orderkey AS VARCHAR) AS pedido, n || n || n || '99' AS chave FROM c"""


def invoice_numbers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey").cast("string")
    s = F.element_at(F.array(F.concat(F.lit("2025/"), k), F.concat(F.lit("2025"), F.lpad(k, 11, "0")), F.concat(F.lit("NF 00"), k), F.concat(F.lit("2025-"), k), k), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    o = o.withColumn("s", s).withColumn("name", F.concat(F.lit("02_NF 2025."), k, F.lit(".pdf")))
    return o.select("o_orderkey", ids.invoice_number(F.col("s")).alias("number"), ids.number_of_file(F.col("name")).alias("in_file"), ids.number_of_file(F.lit("documento.pdf")).alias("none"),
                    ids.same_number(F.concat(F.lit("00"), k), k).alias("same"), ids.same_number(F.concat(F.lit("7"), k), F.concat(F.lit("8"), k)).alias("other"), ids.safe_file_name(F.concat(F.lit("a/b:"), k, F.lit("  c.pdf"))).alias("safe"), ids.batch_id(k).alias("batch"))


NUMBER_SQL = """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS number, '2025.' || o_orderkey AS in_file, CAST(NULL AS VARCHAR) AS "none", true AS same, false AS other,
  'a_b_' || o_orderkey || ' c.pdf' AS safe, 'email_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS batch FROM orders"""


def working_days(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    o = o.withColumn("b", F.date_add("a", (F.pmod("o_orderkey", F.lit(40)) - 5).cast("int")))
    out = workdays.with_working_days(o, workdays.calendar(spark, 1991, 2003), "a", "b")
    return out.select("o_orderkey", "a", "b", F.col("working_days").cast("int").alias("working_days"), workdays.deadline_ok(F.col("working_days")).alias("ok"))


CALENDAR_SQL = """y AS (SELECT unnest(range(1991, 2004)) AS y),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
e AS (SELECT y, make_date(CAST(y AS BIGINT), CAST((h + l - 7 * m + 114) // 31 AS BIGINT), CAST((h + l - 7 * m + 114) % 31 + 1 AS BIGINT)) AS easter FROM e4),
hol AS (SELECT DISTINCT unnest([make_date(y, 1, 1), make_date(y, 4, 21), make_date(y, 5, 1), make_date(y, 9, 7), make_date(y, 10, 12), make_date(y, 11, 2), make_date(y, 11, 15), make_date(y, 12, 25), make_date(y, 1, 25), make_date(y, 11, 20),
  CAST(easter - 48 AS DATE), CAST(easter - 47 AS DATE), CAST(easter - 2 AS DATE), easter, CAST(easter + 60 AS DATE)]) AS d FROM e),
days AS (SELECT CAST(unnest(generate_series(DATE '1991-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
cal AS (SELECT days.d, sum(CASE WHEN isodow(days.d) < 6 AND hol.d IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY days.d) AS cum FROM days LEFT JOIN hol ON days.d = hol.d)"""
WORKDAY_SQL = f"""WITH {CALENDAR_SQL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER) AS DATE) AS b FROM orders),
w AS (SELECT o_orderkey, a, b, CAST(CASE WHEN a < b THEN y2.cum - y1.cum ELSE 0 END AS INTEGER) AS working_days FROM o LEFT JOIN cal y1 ON y1.d = a LEFT JOIN cal y2 ON y2.d = b)
SELECT o_orderkey, a, b, working_days, coalesce(working_days >= 4, false) AS ok FROM w"""


def due_situation(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    o = o.select("o_orderkey", F.lit("1998-06-01").cast("date").alias("today"), F.when(k % 9 != 0, F.date_add(F.lit("1998-06-01").cast("date"), (k % 30 - 8).cast("int"))).alias("due"), F.when(k % 11 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("amount"), F.when(k % 13 != 0, k.cast("string")).alias("number"))
    o = workdays.with_working_days(o, workdays.calendar(spark, 1991, 2003), "today", "due")
    state, warnings = workdays.situation(F.col("due"), F.col("today"), F.col("working_days"), F.col("amount"), F.col("number"))
    return o.select("o_orderkey", state.alias("situation"), warnings.alias("warnings"), export.br_day(F.col("due")).alias("vencimento"))


SITUATION_SQL = f"""WITH {CALENDAR_SQL}, o AS (SELECT o_orderkey, DATE '1998-06-01' AS today, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(DATE '1998-06-01' + CAST(o_orderkey % 30 - 8 AS INTEGER) AS DATE) END AS due,
  CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS number FROM orders),
w AS (SELECT o.*, CAST(CASE WHEN today < due THEN b.cum - a.cum ELSE 0 END AS INTEGER) AS wd FROM o LEFT JOIN cal a ON a.d = today LEFT JOIN cal b ON b.d = due)
SELECT o_orderkey, CASE WHEN number IS NULL OR amount = 0 THEN 'DIVERGENTE' WHEN due IS NULL THEN 'CONFERIR' WHEN due < today THEN 'VENCIDO' WHEN wd <= 4 THEN 'VENCIMENTO_PROXIMO' ELSE 'OK' END AS situation,
  concat_ws(' | ', CASE WHEN number IS NULL OR amount = 0 THEN '[DIVERGENTE] Campos faltando: ' || concat_ws(', ', CASE WHEN number IS NULL THEN 'NF' END, CASE WHEN amount = 0 THEN 'VALOR' END) END,
    CASE WHEN due < today THEN '[VENCIDO] Vencimento em ' || strftime(due, '%d/%m/%Y') END, CASE WHEN due >= today AND wd <= 4 THEN '[URGENTE] Apenas ' || wd || ' dias úteis até vencimento' END,
    CASE WHEN due IS NULL THEN '[CONFERIR] Vencimento não informado' END) AS warnings, coalesce(strftime(due, '%d/%m/%Y'), '') AS vencimento FROM w"""


def text_normalize(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_accents(t)).alias("plain"), F.md5(text.one_space(t)).alias("spaced"), F.md5(text.compact(t)).alias("compact"), F.md5(text.for_extraction(t)).alias("extraction"))


TEXT_SQL = f"""SELECT doc_id, md5(translate(text, '{text.ACCENTED}', '{text.PLAIN}')) AS plain,
  md5(trim(regexp_replace(translate(text, chr(160) || chr(9), '  '), ' +', ' ', 'g'))) AS spaced,
  md5(regexp_replace(upper(translate(replace(text, 'ß', 'ss'), '{text.ACCENTED}', '{text.PLAIN}')), '[^A-Z0-9]+', '', 'g')) AS compact,
  md5(regexp_replace(translate(translate(text, chr(173) || '–—', '---'), chr(65533) || '■□█' || chr(160) || 'Êê', '       '), '[ \\t]+', ' ', 'g')) AS extraction FROM documents"""


def entity_normalize(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    dirty = F.concat(F.lit("Fornecedor:  "), F.translate("s_name", "#", " "), F.lit("   12.345.678/0001-90  "))
    shown = F.element_at(F.array(*[F.replace(F.lit(x[0]), F.lit("{k}"), k.cast("string")) for x in NAMED]), (k % len(NAMED) + 1).cast("int"))
    return s.select("s_suppkey", names.entity_name(shown).alias("name"), names.entity_name(F.lit("LLOOCCAALLIIZZAA RREENNTT AA CCAARR")).alias("pairs"), text.party_key(dirty).alias("key"), ids.company_code(F.col("s_name")).alias("code"))


#: What stands on a document, and the name in it; {k} is the supplier's key.
NAMED = (
    ("EMPRESA XYZ LTDA   12.345.678/0001-90  ", "EMPRESA XYZ LTDA"), ("CORREIOS E TELEGRAFOS Aeee [dede", "CORREIOS E TELEGRAFOS"), ("DOCUMENTO(S)", ""), ("documento: {k}", ""), ("Florida 33134 USA", ""),
    ("Rede Mulher de Televisao Ltda CNPJ: -8", "Rede Mulher de Televisao Ltda"), ("Razão Social ACME LTDA | CNPJ - CNPJ", "ACME LTDA"), ("BeneficiárioREPROMAQ LTDA", "REPROMAQ LTDA"), ("Skymail LTDA 393", "Skymail LTDA"),
    ("EMPRESA A LTDA - CE - FORTALEZA", "EMPRESA A LTDA"), ("ALFA SA www.alfa.com.br", "ALFA SA"), ("( ) Mudou-se", ""), ("CEP: -325 - PRAIA", ""), ("dcadvogados.com.br x", ""), ("VERO S.A. CNL.", "VERO S.A."), ("Contas a Receber", ""),
    ("EMPRESA {k}.{k} LTDA ******/********", "EMPRESA LTDA"), ("BETA LTDA F50C0E532 Inscrição Municipal 1", "BETA LTDA"), ("GAMA LTDA, inscrita no CNPJ/MF sob", "GAMA LTDA"), ("MG", ""), ("ab", ""), ("DELTA LTDA financeiro", "DELTA LTDA"), ("Nome Empresarial", ""),
)
ENTITY_SQL = f"""SELECT s_suppkey, [{', '.join("'" + x[1] + "'" for x in NAMED)}][s_suppkey % {len(NAMED)} + 1] AS name, 'LOCALIZA RENT A CAR' AS pairs,
  upper(replace(s_name, '#', ' ')) || ' 12.345.678/0001-90' AS key, 'SUPPLIER' AS code FROM supplier"""


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("text_md5"))


HTML_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS t FROM a), c AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM b),
e AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM c)
SELECT page_id, md5(trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM e"""


def chunk_overlap(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 500, 50)).alias("i", "chunk"))
    return c.select("doc_id", "i", F.md5("chunk").alias("chunk_md5"), text.chunk_key(F.col("doc_id").cast("string"), F.col("i")).alias("key"))


CHUNK_SQL = r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 500 THEN [0] ELSE range(0, len(w), 450) END) AS s FROM w)
SELECT doc_id, CAST(s // 450 AS INTEGER) AS i, md5(array_to_string(list_slice(w, s + 1, s + 500), ' ')) AS chunk_md5, md5(doc_id || '::' || (s // 450)) AS key FROM s"""


def reassemble(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 500, 50)).alias("i", "chunk"))
    whole = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "chunk"))).alias("c"))
    return whole.select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join(F.transform("c", lambda x: x["chunk"]), "\n\n")).alias("text_md5"))


REASSEMBLE_SQL = r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 500 THEN [0] ELSE range(0, len(w), 450) END) AS s FROM w),
c AS (SELECT doc_id, s, array_to_string(list_slice(w, s + 1, s + 500), ' ') AS c FROM s)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_chunks, md5(string_agg(c, chr(10) || chr(10) ORDER BY s)) AS text_md5 FROM c GROUP BY doc_id"""


def template_topk(spark, d):
    e = table(spark, d, "events")
    m = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" file_"), F.pmod("event_id", F.lit(9)).cast("string"), F.lit(".pdf ["), F.pmod("event_id", F.lit(3)).cast("string"), F.lit("/3]"))
    return e.groupBy(text.template(m).alias("template")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(10)


TEMPLATE_SQL = r"""SELECT event_type || ' user <N> <PDF> [x/y]' AS template, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, template LIMIT 10"""


def json_fields(spark, d):
    e = table(spark, d, "events")
    p = F.from_json("props", "k BIGINT")
    labels = F.map_from_arrays(F.array(F.lit("type"), F.lit("k")), F.array(F.col("event_type"), p["k"].cast("string")))
    key = F.concat(F.lit("events{"), F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","), F.lit("}"))
    return e.select("event_id", p["k"].alias("k"), key.alias("metric_key"), F.to_json(F.struct("event_type", p["k"].alias("k"))).alias("json"))


JSON_SQL = """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'events{k=' || json_extract_string(props, '$.k') || ',type=' || event_type || '}' AS metric_key,
  '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS json FROM events"""

QUERIES = {f.__name__: f for f in (money_parse, money_extract, slip_line_fields, date_parse_br, id_extract, invoice_numbers, working_days, due_situation, text_normalize, entity_normalize, html_to_text, chunk_overlap, reassemble, template_topk, json_fields)}
SQL = {
    "money_parse": "SELECT o_orderkey, price AS parsed, CAST(0 AS DOUBLE) AS bad, price AS sheet, other AS xml FROM (" + SQL_RENDERED + ")",
    "money_extract": "SELECT o_orderkey, printf('%.2f', price) || '|' || printf('%.2f', other) AS amounts, greatest(price, other) AS largest FROM (" + SQL_RENDERED + ")",
    "slip_line_fields": SLIP_SQL, "date_parse_br": DATE_SQL, "id_extract": ID_SQL, "invoice_numbers": NUMBER_SQL, "working_days": WORKDAY_SQL, "due_situation": SITUATION_SQL,
    "text_normalize": TEXT_SQL, "entity_normalize": ENTITY_SQL, "html_to_text": HTML_SQL, "chunk_overlap": CHUNK_SQL, "reassemble": REASSEMBLE_SQL, "template_topk": TEMPLATE_SQL, "json_fields": JSON_SQL,
}
