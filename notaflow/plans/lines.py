"""Queries over lines and names of documents, bank fields, companies in texts, kinds of batches. Lines are rendered from
orders; the SQL renders the same lines and applies the rules with its own regular expressions."""

from pyspark.sql import functions as F

from ..functions import fixed, lines, money
from ..operators import companies, fields, health, vendors, water
from ..sources.tables import table
from .documents import _fill


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"



LINES = ("R$ {v}", "Real 1 14.338.304/0001-78 {d} {v}", "{d} {v}", "{d} sem valor", "34191.09008 63571.277308 71444.640008 {k}", "{k}", "RUA DAS FLORES {k}", "Av. Brasil", "AVENIDA {k} - CENTRO", "EMPRESA X LTDA (BETIM/MG)", "CEP: 32600-100", "9", "", "R$", "FORNECEDOR {k} S.A.",
         "Nº {k} casa", "ROTA SEM NADA", "00012345678901234567890123456789012345678901 {k}", "realeza {v}", "Estrada Real {k}", "  7 ", "Contato")
NAMES = ("CHAVE DE ACESSO: {k}", "CNPJ 12.345.678/0001-90", "Empresa {k} Ltda", "IE: {k}", "DANFE", "Danfex Comercio", "12.345.678/0001-90", "https://x.com/{k}", "Nome CPF/CNPJ Vencimento", "BETIM / MG", "BETIM / MG - CEP 32600", "(-) Desconto", "ab", "", "FATURA DE SERVICO {k}", "N DO CLIENTE",
         "RUA DAS FLORES {k}", "AV. Brasil 1", "Nota Fiscal Fatura de Servico", "DOCUMENTO AUXILIAR DA NOTA", "COMUNICACAO ELETRONICA {k}", "VIVO TELECOM", "Palavra", "Duas palavras", "12345678901234", "1.2 {k}", "tim s..", "Insc. Est. {k}", "ME ")
BANK = ("Agência: 1.234 - 5 Conta Corrente: {k}-7 Banco 341", "Agencia 0{k} C/C 12345-6 Código Banco: 999", "Ag. 12 34 Conta 99", "Conta: {k}0000 - 1 sem banco", "nada {k}", "AGÊNCIA {k} BANCO do Brasil 001")
HEADED = ("EMPRESA {k} X - CNPJ 12.345.678/0001-90", "BENEFICIÁRIO ACME SERVICOS LTDA - CNPJ 12.345.678/0001-90 fim", "Vencimento Pagador 12.345.678/0001-90", "AB 12.345.678/0001-90", "12.345.678/0001-90 DEPOIS LTDA", "sem numero {k}", "Valor do Documento COMERCIAL UNIAO S.A. 12.345.678/0001-90", "1 2 3 VIA SUL & CIA 12.345.678/0001-90")


def _rendered(spark, d, templates):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    text = F.element_at(F.array(*[_fill(x) if x else F.lit("") for x in templates]), (F.col("o_orderkey") % len(templates) + 1).cast("int"))
    return o.select("o_orderkey", text.alias("t"))


def _rendered_sql(templates):
    """l: o_orderkey, t."""
    amount = "replace(replace(replace(format('{:,.2f}', round(o_totalprice, 2)), ',', '#'), '.', ','), '#', '.')"
    put = {"{k}": "CAST(o_orderkey AS VARCHAR)", "{v}": amount, "{d}": "strftime(o_orderdate, '%d/%m/%Y')"}

    def text(layout):
        pieces = [x for x in layout.replace("{", "\x00{").replace("}", "}\x00").split("\x00") if x]
        return " || ".join(put.get(x) or _q(x) for x in pieces) or "''"

    return f"l AS (SELECT o_orderkey, CASE o_orderkey % {len(templates)} " + " ".join(f"WHEN {i} THEN {text(x)}" for i, x in enumerate(templates)) + " END AS t FROM orders)"


def line_kinds(spark, d):
    t = F.col("t")
    return _rendered(spark, d, LINES).select("o_orderkey", lines.currency_line(t).alias("currency"), lines.digit_line(t).alias("digits"), lines.address_line(t).alias("address"), lines.noise_line(t).alias("noise"))


def supplier_names(spark, d):
    t = F.col("t")
    return _rendered(spark, d, NAMES).select("o_orderkey", lines.invalid_goods_supplier(t).alias("invalid_goods"), lines.valid_comm_supplier(t).alias("valid_comm"))


def bank_fields(spark, d):
    t = F.col("t")
    line = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lpad((F.col("o_orderkey") % 800).cast("string"), 3, "0"), F.lit("91.09008")))
    return _rendered(spark, d, BANK).select("o_orderkey", lines.bank_name(t, line).alias("bank"), lines.agency(t).alias("agency"), lines.account(t).alias("account"))


def names_before_cnpj(spark, d):
    return _rendered(spark, d, HEADED).select("o_orderkey", lines.name_before_cnpj(F.col("t"), F.lit("12.345.678/0001-90")).alias("name"))


def notice_texts(spark, d):
    k = F.col("o_orderkey")
    link = F.when(k % 5 != 0, F.concat(F.when(k % 3 == 0, F.lit("https://click.omie.com.br/")).otherwise(F.lit("https://nfe.example/")), F.repeat(F.lit("x"), (k % 120).cast("int"))))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", lines.notice(link, F.when(k % 2 == 0, F.concat(F.lit("C"), k)), F.when(k % 7 == 0, k.cast("string"))).alias("text"))


def cnpj_offsets(spark, d):
    """Numbers of suppliers in the text of an order, with where they stand."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    body = F.array_join(F.transform("s", lambda s: F.concat(F.lit("n "), F.lpad(s.cast("string"), 14, "1"))), ";")
    return li.select("l_orderkey", F.posexplode(companies.cnpjs_with_offsets(body)).alias("i", "o")).select("l_orderkey", "i", "o.raw", "o.start", "o.end")


def _own(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey <= 9")
    return s.select(F.lpad((F.col("s_suppkey") * 11).cast("string"), 14, "0").alias("cnpj"), F.concat(F.lit("E"), "s_suppkey", F.lit(" GESTAO LTDA")).alias("name"), F.col("s_suppkey").alias("pos"))


def company_match(spark, d):
    """By number in the best surroundings, by code, by domain, or none: one way for each remainder of the order's key."""
    return matched_companies(table(spark, d, "orders").where("o_orderkey % 2 = 1"), _own(spark, d))


def matched_companies(o, own):
    k, a, b = F.col("o_orderkey"), (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 7 + 1).cast("string")
    far = F.lit(" " + "." * 600 + " ")
    number = lambda x: F.lpad((x.cast("bigint") * 11).cast("string"), 14, "0")
    text = (F.when(k % 5 == 0, F.concat(F.lit("CNPJ "), number(a), far, F.lit("dados do pagador "), number(b)))
            .when(k % 5 == 1, F.concat(F.lit("para E"), b, F.lit(", e E"), a, F.lit(".")))
            .when(k % 5 == 2, F.concat(F.lit("contato nf@e"), a, F.lit("tecnico.com.br")))
            .when(k % 5 == 3, F.concat(F.lit("12345678000190 E"), a, F.lit("x"))).otherwise(F.concat(number(a), far, number(b))))
    return companies.company_of(o.select("o_orderkey", text.alias("text")), own, "o_orderkey", "text")


#: Mails: the text, where {a} and {b} are codes, {n} a number of a's; what it says: the first or second company or none, and how.
MAILS = (
    ("segue nota\nCNPJ {n} e E{b}A", "a", "cnpj"), ("Para: E{a}A Gestao <x@y.br>\nE{b}A", "a", "nome_exato"), ("TOMADOR: casa E{a}A\nsenha: E{b}A", "a", "nome_exato"), ("ola E{a}A tudo bem", "a", "nome_exato"),
    ("ola E{a}A e E{b}A", None, None), ("senha do portal: E{a}A", None, None), ("Frase de segurança: E{a}A\nE{b}A", "b", "nome_exato"), ("http://click.x.com/E{a}A href=\"E{b}A\"", None, None), ("para CENTRAL{x}", "x", "nome_parcial"),
    ("GESTAO LTDA", None, None), ("<style>E{a}A</style> E{b}A@gmail.com", None, None), ("cliente E{b}A, E{a}A", "first", "nome_exato"), ("E{a}AB E{b}", None, None), ("", None, None), ("numero 1{n}", None, None),
)


def _mail_texts(spark, d):
    k = F.col("o_orderkey")
    a, b = (k % 9 + 1), ((k % 9 + k % 7 + 1) % 9 + 1)
    fill = {"{a}": a.cast("string"), "{b}": b.cast("string"), "{n}": F.lpad((a * 11).cast("string"), 14, "0"), "{x}": F.element_at(F.array(*map(F.lit, "ABCDEFGHI")), a.cast("int"))}
    text = F.element_at(F.array(*[F.lit(m[0]) for m in MAILS]), (k % len(MAILS) + 1).cast("int"))
    for mark, value in fill.items():
        text = F.replace(text, F.lit(mark), value)
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


def company_in_mail(spark, d):
    own = table(spark, d, "supplier").where("s_suppkey BETWEEN 1 AND 9")
    letter = F.char(F.lit(64) + F.col("s_suppkey"))  # A to I; defined for every key, as Spark may test the name before the key
    own = own.select(F.lpad((F.col("s_suppkey") * 11).cast("string"), 14, "0").alias("cnpj"), F.concat(F.lit("E"), "s_suppkey", F.lit("A CENTRAL"), letter, F.lit(" GESTAO LTDA")).alias("name"), F.col("s_suppkey").alias("pos"))
    return companies.company_in_mail(_mail_texts(spark, d), own, "o_orderkey", "text")


MAILS_SQL = f"""WITH m(i, who, how) AS (VALUES {', '.join(f"({i}, {'NULL' if w is None else chr(39) + w + chr(39)}, {'NULL' if h is None else chr(39) + h + chr(39)})" for i, (_, w, h) in enumerate(MAILS))}),
o AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS a, (o_orderkey % 9 + o_orderkey % 7 + 1) % 9 + 1 AS b FROM orders)
SELECT o_orderkey, CASE who WHEN 'a' THEN 'E' || a || 'A' WHEN 'x' THEN 'E' || a || 'A' WHEN 'b' THEN 'E' || b || 'A' WHEN 'first' THEN 'E' || least(a, b) || 'A' END AS code, how AS method FROM o JOIN m ON i = o_orderkey % {len(MAILS)}"""


def company_names(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, F.lit("Csc Gestao ")).when(k % 3 == 1, F.lit("Cscx Centro ")).otherwise(F.lit("Loja OP11-")), k.cast("string"))
    known = (("01", "CSC GESTAO INTEGRADA", "BELO HORIZONTE"), ("02", "MASTER CENTRO", "BETIM"))
    asked = F.element_at(F.array(*map(F.lit, ("csc", "Betim", "", "nada"))), (k % 4 + 1).cast("int"))
    return s.select("s_suppkey", companies.own_name(name, ("CSC", "OP11", "CENTRO", "MUITOLONGO")).alias("own"), companies.cnpj_of(asked, known).alias("cnpj"))


def company_swap(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    docs = o.select("o_orderkey", F.when(k % 5 != 0, F.lit("CSC")).alias("empresa"), (k % 2 == 0).alias("name_ours"), (k % 3 == 0).alias("cnpj_ours"), F.when(k % 7 != 0, F.lit("12345678000190")).alias("foreign"), F.lit("NOME").alias("fornecedor_nome"), F.when(k % 4 != 0, F.lit("C1")).alias("cnpj"))
    return companies.corrected(docs).select("o_orderkey", "fornecedor_nome", "cnpj")


def supplier_guesses(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("linha um\n  Loja   "), k.cast("string"), F.lit("  Ltda \nfim"))).otherwise(F.lit("Ltda"))
    g = companies.supplier_guess(F.lit("ATUAL"), F.when(k % 5 == 0, F.lit("INFERIDO")).when(k % 5 == 1, F.lit("ATUAL")), k % 10 == 0, F.when(k % 3 == 0, F.lit("12345678000190")), text)
    return o.select("o_orderkey", g.alias("g")).select("o_orderkey", "g.*")


WHO = ("EDP SAO PAULO", "PP EMPREENDIMENTOS LTDA", "MARIA DA SILVA", "COPASA MG", "ACME COMERCIO E SERVICOS LTDA", "JOAO", "", "LOJA DE LUZ 24 HORAS BRASIL")
WHAT = ("Conta de energia", "Pgto consumo", "Comprovante TED", "Agua e saneamento", "Fatura", "Luz")


def batch_kinds(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    who = F.element_at(F.array(*map(F.lit, WHO)), (k % len(WHO) + 1).cast("int"))
    what = F.element_at(F.array(*map(F.lit, WHAT)), (F.floor(k / 8) % len(WHAT) + 1).cast("int"))
    files = F.when(k % 11 == 0, F.array(F.lit("01_comp pgto.pdf"))).otherwise(F.array(F.lit("nf.pdf")))
    subtypes = F.when(k % 13 == 0, F.array(F.lit("Pix")))
    return o.select("o_orderkey", health.kind(who, what, (k % 17 == 0).cast("int"), (k % 19 == 0).cast("int"), (k % 23 != 0).cast("int"), files, subtypes).alias("kind"))


def weighted_amounts(spark, d):
    """Three vendors' papers: item lines, totals and small credits in different orders."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    br = lambda x: money.render_br(F.round(x, 2))
    text = F.concat(F.lit("credito 5,00\n1 item "), br(F.round(v, 2) - 100.5), F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("VALOR TOTAL R$ "), br(v))).otherwise(F.concat(F.lit("Valor do Documento "), br(F.round(v, 2) - 300.25))), F.lit("\nV.UNIT TOTAL "), br(F.round(v, 2) - 200.75), F.lit("\nR$ 0,00"))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", *[fields.weighted_amount(F.col("t"), w).alias(n) for n, w in (("mugo", vendors.MUGO), ("pro_painel", vendors.PRO_PAINEL), ("acimoc", vendors.ACIMOC))])


def water_mails(spark, d):
    k = F.col("o_orderkey")
    day, amount = F.date_format("o_orderdate", "dd/MM/yyyy"), money.render_br(F.round("o_totalprice", 2))
    bold = F.concat(F.lit("<b>Fornecimento:</b> "), F.lpad(k.cast("string"), 12, "8"), F.lit("<br><b>Unidade:</b> TAUBATE<br><b>Vencimento:</b> "), day, F.lit("<br><b>Valor:</b> R$ "), amount)
    plain = F.concat(F.lit("Fornecimento: "), F.lpad(k.cast("string"), 12, "8"), F.lit("\nVencimento: "), day, F.lit("\nValor: R$ "), amount, F.lit("\nCódigo de barras: 82660000001 0  38560097091 2  10655945380 3  19573630603 4\n"))
    body = F.when(k % 4 == 0, bold).when(k % 4 == 1, plain).otherwise(F.concat(F.lit("R$ "), amount))
    o = table(spark, d, "orders").select("o_orderkey", water.is_water_mail(F.when(k % 8 == 2, F.lit("Sua fatura digital")), F.when(k % 8 == 3, F.lit("noreply@sabesp.com.br")), body).alias("water"), water.water_bill(body).alias("b"))
    return o.select("o_orderkey", "water", "b.valor", "b.vencimento", "b.numero_documento", "b.linha_digitavel", "b.observacoes")


QUERIES = {f.__name__: f for f in (line_kinds, supplier_names, bank_fields, names_before_cnpj, notice_texts, cnpj_offsets, company_match, company_in_mail, company_names, company_swap, supplier_guesses, batch_kinds, weighted_amounts, water_mails)}


def _one_of(value, patterns):
    return f"regexp_matches({value}, {_q('|'.join(f'(?:{p})' for p in patterns))})"


_MONEY = r"'\b\d{1,3}(?:\.\d{3})*,\d{2}\b'"
_U = "upper(t)"
_UT = "upper(trim(t))"
_UNDER = "(" + " OR ".join(f"contains({_UT}, {_q(w)})" for w in fixed.COMPANY_WORDS) + ")"
_ACCOUNT = "CASE WHEN length({n}) >= {least} THEN {n} || CASE WHEN {c} <> '' THEN '-' || {c} ELSE '' END END"


def _account_sql(pattern, least):
    n, c = rf"regexp_replace(regexp_extract(t, {_q(pattern)}, 1), '\D', '', 'g')", f"regexp_extract(t, {_q(pattern)}, 2)"
    return _ACCOUNT.format(n=n, c=c, least=least)


_CODE = "coalesce(CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_orderkey % 800 AS VARCHAR), 3, '0') END, nullif(regexp_extract(t, '(?i)(?:Banco|C[oó]digo\\s+Banco)[^\\d]*(\\d{3})', 1), ''))".replace("\\\\", "\\")
_BANKS = "CASE code " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in fixed.BANKS.items()) + " ELSE 'BANCO_' || code END"
_LEFT = r"trim(regexp_replace(left(t, strpos(t, '12.345.678/0001-90') - 1), '(?i)[-–]?\s*CNPJ\s*$', ' '))"
_SQUEEZED = rf"trim(regexp_replace(regexp_replace({_LEFT}, {_q(r'(?i)\b(?:' + '|'.join(fixed.SLIP_LABELS) + r')\b')}, ' ', 'g'), '\s+', ' ', 'g'))"
_HAS = lambda v, words: "(" + " OR ".join(f"contains({v}, {_q(w)})" for w in words) + ")"
SQL = {
    "line_kinds": f"""WITH {_rendered_sql(LINES)} SELECT o_orderkey,
  contains({_U}, 'R$') OR (regexp_matches(t, {_MONEY}) AND (regexp_matches({_U}, '\\bREAL\\b') OR regexp_matches(t, '\\b\\d{{2}}/\\d{{2}}/\\d{{4}}\\b'))) AS currency,
  regexp_matches(t, '\\d{{5}}[.\\s]\\d{{5}}\\s+\\d{{5}}[.\\s]\\d{{6}}\\s+\\d{{5}}[.\\s]\\d{{6}}') OR (length(regexp_replace(t, '\\D', '', 'g')) >= 40 AND length(regexp_replace(t, '\\D', '', 'g')) > length(t) * 0.6) AS digits,
  regexp_matches({_U}, {_q('^(?:' + '|'.join(fixed.ADDRESS_BEGINS) + ')')}) OR {_one_of(_U, fixed.ADDRESS_PARTS)} AS address,
  regexp_full_match(trim(t), '(?i)(?:\\d{{1,2}}|R?\\$?)') AS noise FROM l""",
    "supplier_names": f"""WITH {_rendered_sql(NAMES)} SELECT o_orderkey, length(trim(t)) < 3 OR regexp_matches({_UT}, {_q('^(?:' + '|'.join(fixed.NO_GOODS_SUPPLIER) + ')')}) AS invalid_goods,
  length(trim(t)) >= 3 AND NOT contains({_UT}, 'DOCUMENTO AUXILIAR') AND NOT (contains({_UT}, 'NOTA FISCAL FATURA') AND contains({_UT}, 'SERVIÇO')) AND NOT {_HAS(_UT, ('COMUNICAÇÃO ELETRÔNICA', 'COMUNICACAO ELETRONICA'))}
  AND NOT ({' OR '.join(f'starts_with({_UT}, {_q(w)})' for w in fixed.STREETS)}) AND NOT regexp_full_match(trim(t), '\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}') AND NOT regexp_full_match(regexp_replace(trim(t), '[./-]', '', 'g'), '\\d{{14,}}')
  AND ({_UNDER} OR (len(string_split_regex(trim(t), '\\s+')) >= 2 AND length(trim(t)) >= 5)) AS valid_comm FROM l""",
    "bank_fields": f"WITH {_rendered_sql(BANK)}, c AS (SELECT *, {_CODE} AS code FROM l) SELECT o_orderkey, {_BANKS} AS bank, coalesce({_account_sql('(?i)Ag[eê]ncia[^0-9]*([0-9.' + chr(92) + 's]{2,15})' + chr(92) + 's*[-–]?' + chr(92) + 's*([0-9])?', 1)}, {_account_sql('(?i)Ag[.' + chr(92) + 's]*[:' + chr(92) + 's]*([0-9.' + chr(92) + 's]{2,15})' + chr(92) + 's*[-–]?' + chr(92) + 's*([0-9])?', 1)}) AS agency, coalesce("
                   + ", ".join(_account_sql(rf"(?i){x}[^0-9]*([0-9]{{1,12}})[\s-]?([0-9])?", 4) for x in (r"Conta\s+Corrente", "C/?C", "Conta")) + ") AS account FROM c",
    "names_before_cnpj": rf"WITH {_rendered_sql(HEADED)}, x AS (SELECT o_orderkey, CASE WHEN contains(t, '12.345.678/0001-90') THEN trim(regexp_extract({_SQUEEZED}, '([A-ZÀ-ÿ][A-ZÀ-ÿ\s&.\-/]{{5,160}})\s*$', 1)) END AS n FROM l) SELECT o_orderkey, CASE WHEN length(n) >= 5 THEN n END AS name FROM x",
    "notice_texts": """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'https://click.omie.com.br/' ELSE 'https://nfe.example/' END || repeat('x', CAST(o_orderkey % 120 AS INTEGER)) END AS link FROM orders)
SELECT k AS o_orderkey, CASE WHEN link IS NOT NULL OR k % 2 = 0 OR k % 7 = 0 THEN concat_ws(' | ', '[SEM ANEXO]', CASE WHEN k % 3 = 0 THEN 'Link (Omie): ' ELSE 'Link: ' END || CASE WHEN length(link) > 100 THEN left(link, 97) || '...' ELSE link END, CASE WHEN k % 2 = 0 THEN 'Código: C' || k END, CASE WHEN k % 7 = 0 THEN 'NF: ' || k END) END AS text FROM x""",
    "cnpj_offsets": "WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS j FROM s) SELECT l_orderkey, CAST(j AS INTEGER) AS i, lpad(CAST(l_suppkey AS VARCHAR), 14, '1') AS raw, CAST(j * 17 + 2 AS INTEGER) AS start, CAST(j * 17 + 16 AS INTEGER) AS \"end\" FROM n",
    "company_in_mail": MAILS_SQL,
    "company_match": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 + 1 AS a, o_orderkey % 7 + 1 AS b, o_orderkey % 5 AS r FROM orders WHERE o_orderkey % 2 = 1),
c AS (SELECT *, CASE r WHEN 0 THEN b WHEN 1 THEN least(a, b) WHEN 2 THEN a WHEN 4 THEN a END AS e FROM o)
SELECT k AS o_orderkey, 'E' || e AS code, lpad(CAST(e * 11 AS VARCHAR), 14, '0') AS cnpj, CASE r WHEN 0 THEN 'cnpj' WHEN 1 THEN 'nome' WHEN 2 THEN 'domain' WHEN 4 THEN 'cnpj' END AS method, CAST(CASE r WHEN 0 THEN 16 WHEN 1 THEN 5 WHEN 2 THEN 9 WHEN 4 THEN 10 END AS INTEGER) AS score FROM c""",
    "company_names": "SELECT s_suppkey, s_suppkey % 3 <> 1 AS own, CASE s_suppkey % 4 WHEN 0 THEN '01' WHEN 1 THEN '02' END AS cnpj FROM supplier",
    "company_swap": "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS f, o_orderkey % 4 <> 0 AS c, o_orderkey % 3 = 0 AS u FROM orders) SELECT k AS o_orderkey, CASE WHEN f AND k % 2 = 0 AND (NOT c OR u) THEN NULL ELSE 'NOME' END AS fornecedor_nome, CASE WHEN f AND c AND u AND k % 7 <> 0 THEN '12.345.678/0001-90' WHEN c THEN 'C1' END AS cnpj FROM o",
    "supplier_guesses": """WITH o AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT k, CASE WHEN k % 5 = 0 AND k % 10 <> 0 THEN 'infer' WHEN k % 3 = 0 THEN 'cnpj_only' WHEN k % 2 = 0 THEN 'pattern_match' ELSE 'no_match' END AS method FROM o)
SELECT k AS o_orderkey, method <> 'no_match' AS corrected, CASE method WHEN 'infer' THEN 'INFERIDO' WHEN 'cnpj_only' THEN 'CNPJ: 12.345.678/0001-90' WHEN 'pattern_match' THEN 'LOJA ' || k || ' LTDA' END AS suggested, method, CAST(CASE method WHEN 'infer' THEN 0.8 WHEN 'cnpj_only' THEN 0.6 WHEN 'pattern_match' THEN 0.4 ELSE 0 END AS DOUBLE) AS confidence FROM m""",
    "batch_kinds": f"""WITH o AS (SELECT o_orderkey AS k, upper([{', '.join(map(_q, WHO))}][o_orderkey % {len(WHO)} + 1]) AS who, upper([{', '.join(map(_q, WHAT))}][o_orderkey // 8 % {len(WHAT)} + 1]) AS what FROM orders),
x AS (SELECT *, len(list_filter(string_split(who, ' '), lambda w: w <> '')) AS n, {_HAS('who', ('LTDA', 'S.A.', 'S/A', 'EIRELI', 'MEI'))} AS company FROM o),
y AS (SELECT *, {_HAS('what', health.PAID)} OR (n >= 3 AND NOT company AND NOT regexp_matches(who, '[0-9]') AND {_HAS('what', ('CONSUMO', 'PAGAMENTO', 'PGTO'))}) OR k % 11 = 0 OR k % 13 = 0 AS paid FROM x)
SELECT k AS o_orderkey, CASE WHEN k % 17 = 0 THEN 'NFSE' WHEN k % 19 = 0 THEN 'BOLETO' WHEN k % 23 = 0 THEN 'EMAIL_BODY' WHEN paid THEN 'COMPROVANTE_PAGAMENTO' WHEN {_HAS('who', health.RENTAL)} THEN 'OUTRO' WHEN {_HAS('who', health.POWER)} THEN 'UTILITY_ENERGY' WHEN {_HAS('who', health.WATER)} THEN 'UTILITY_WATER'
  WHEN (company OR n > 3) AND {_HAS('what', ('ENERGIA', 'LUZ', 'ELETRIC'))} THEN 'UTILITY_ENERGY' WHEN (company OR n > 3) AND {_HAS('what', ('AGUA', 'ÁGUA', 'SANEAMENTO'))} THEN 'UTILITY_WATER' ELSE 'OUTRO' END AS kind FROM y""",
    "weighted_amounts": """WITH o AS (SELECT o_orderkey AS k, round(round(o_totalprice, 2) - 100.5, 2) AS item, round(o_totalprice, 2) AS whole, round(round(o_totalprice, 2) - 300.25, 2) AS part, round(round(o_totalprice, 2) - 200.75, 2) AS unit FROM orders),
a AS (SELECT k, unnest([{'l': 0, 'v': 5.0}, {'l': 1, 'v': item}, {'l': CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END, 'v': CASE WHEN k % 2 = 0 THEN whole ELSE part END}, {'l': 4, 'v': unit}]) AS x FROM o),
w AS (SELECT k, x.v AS v, CASE WHEN x.v > 1000 THEN 3 WHEN x.v > 100 THEN 2 WHEN x.v > 10 THEN 1 ELSE 0 END AS more, CASE x.l WHEN 2 THEN 10 WHEN 1 THEN CASE WHEN x.v > 100 THEN 6 ELSE 1 END ELSE 1 END AS mugo, CASE x.l WHEN 2 THEN 10 WHEN 3 THEN 12 WHEN 4 THEN 10 ELSE 1 END AS pro, CASE WHEN x.l IN (2, 3) THEN 2 ELSE 1 END AS acimoc FROM a)
SELECT k AS o_orderkey, arg_max(v, (mugo + more, v)) AS mugo, arg_max(v, (pro + more, v)) AS pro_painel, arg_max(v, (acimoc, v)) AS acimoc FROM w GROUP BY k""",
    "water_mails": """SELECT o_orderkey, o_orderkey % 4 < 2 OR o_orderkey % 8 IN (2, 3) AS water, round(o_totalprice, 2) AS valor, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS vencimento, CASE WHEN o_orderkey % 4 < 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '8') END AS numero_documento,
  CASE WHEN o_orderkey % 4 = 1 THEN '826600000010385600970912106559453803195736306034' END AS linha_digitavel, CASE WHEN o_orderkey % 4 = 0 THEN 'Unidade: TAUBATE' END AS observacoes FROM orders""",
}
