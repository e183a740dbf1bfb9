"""Queries over the supplier cascades and administrative documents.

Each document is put together from blocks of a layout, chosen by its key; a block alone says what its rule would find, so
SQL can tell what a document of several blocks must give: the earliest rule's block wins, or marks add up."""

from pyspark.sql import functions as F

from ..operators import admin, cascades, router
from ..sources.tables import spread, table

#: Blocks of a slip: the rule's place in the cascade, its name, the text and the name found. {n}: a company, {m}: a person, {c}: digits.
SLIP_BLOCKS = (
    (1, "label alone", "Cedente\n001-9\nAutenticação mecânica\n{n} LTDA", "{n} LTDA"),
    (1, "label alone", "CEDENTE\n00190.00009 02813.907000\nVencimento\n\n{n} DISTRIBUICAO", "{n} DISTRIBUICAO"),
    (1, "label alone", "cedente\nR$ 10,00\n1 x\nRua das Flores 12\n{n} EIRELI", "{n} EIRELI"),
    (2, "on behalf", "Cobra a serviço de {n} S/A - CNPJ 02.351.877/0001-52 hoje", "Cobra a serviço de {n} S/A - CNPJ 02.351.877/0001-52"),
    (2, "on behalf", "Paga  a servico de {n} - CNPJ: 02.351.877/0001-52", "Paga a servico de {n} - CNPJ 02.351.877/0001-52"),
    (2, "on behalf", "Meio A SERVIÇO DE {n} LTDA – CNPJ 02.351.877/0001-52", "Meio A SERVIÇO DE {n} LTDA - CNPJ 02.351.877/0001-52"),
    (3, "name with number", "CSC PAGADORA LTDA - CNPJ 38.323.227/0001-40\nOUTRA CASA - CNPJ 11.111.111/0001-11\n{n} LTDA - CNPJ: 22.222.222/0001-22", "{n} LTDA - CNPJ 22.222.222/0001-22"),
    (3, "name with number", "{n} S/A - CNPJ 22.222.222/0001-22\nSEGUNDA LTDA - CNPJ 23.222.222/0001-22", "{n} S/A - CNPJ 22.222.222/0001-22"),
    (3, "name with number", "R$ 1,00 REAL - CNPJ 11.111.111/0001-11\n{n} SA - CNPJ 22.222.222/0001-22", "{n} SA - CNPJ 22.222.222/0001-22"),
    (4, "before number", "Beneficiário Vencimento Valor do Documento {n} SERVICOS LTDA 18.363.307/0001-12 08/11/2025", "{n} SERVICOS LTDA"),
    (4, "before number", "Beneficiário: {n} ME CNPJ 18.363.307/0001-12", "{n} ME"),
    (4, "before number", "Beneficiario final {n} EIRELI 18.363.307/0001-12", "{n} EIRELI"),
    (5, "under payee", "Beneficiário Agência / Código\n{n} COMERCIO SA", "{n} COMERCIO SA"),
    (5, "under payee", "Dados do Beneficiário\nVencimento\nRua das Flores 12\n{n} COMERCIO", "{n} COMERCIO"),
    (5, "under payee", "Beneficiário\nNosso número\nR$ 5,00\n{n} DE MINAS", "{n} DE MINAS"),
    (4.5, "before number", "Cedente {n} 123.456.789-01", "{n}"),
    (8, "person", "Beneficiário {m} CPF 123.456.789-01", "{m}"),
    (8, "person", "Nome: {m} 123.456.789-01\nCPF: 123.456.789-01", "{m}"),
    (8, "person", "Cedente {m} 123.456.789-01", "{m}"),
    (99, None, "Pedido {c}\nObrigado pela preferência", None),
    (99, None, "Cedente\n123-4\nVencimento", None),
    (99, None, "Nosso número {c}", None),
)
#: Lines that end what a block's rule reads.
SLIP_END = "\nPagador\n1\n2\n3\n4\n5\n6\n"

NOTE_BLOCKS = (
    (1, "provider section", "PRESTADOR DE SERVIÇOS\nCPF/CNPJ:\nNome/Razão Social:\nEndereço:\n13.114.403/0001\nInscrição Municipal:\n4.209.159-4\n{n} S.A\nPRAÇA X", "{n} S.A"),
    (1, "provider section", "Prestador de Serviços\nNome/Razao Social:\nRUA DAS FLORES\n{n} DO NORTE\nx", "{n} DO NORTE"),
    (1, "provider section", "PRESTADOR DE SERVICOS\nNome/Razão Social:\nGRUPO PROPRIO LTDA\n\nUF: MG\n{n} LTDA", "{n} LTDA"),
    (2, "legal name", "Nome/Razão social:{n} LTDA\nx", "{n} LTDA"),
    (2, "legal name", "Nome/Razao Social: {n} EIRELI Inscrição estadual:", "{n} EIRELI"),
    (2, "legal name", "NOME/RAZÃO SOCIAL :\n{n} EPP\n", "{n} EPP"),
    (3, "name and mail run together", "Nome/NomeEmpresarial E-mail\n57.428.297{n} contato@x.com", "{n}"),
    (3, "name and mail run together", "NOME/NOMEEMPRESARIAL E-MAIL\n 57{n} a.b@x.com", "{n}"),
    (3, "name and mail run together", "Nome/NomeEmpresarial  E-mail \n\n57.4{n} c@x.com", "{n}"),
    (4, "name over mail", "Nome / Nome Empresarial\nE-mail\n{n} SEGURANCA\nfin@x.com", "{n} SEGURANCA"),
    (4, "name over mail", "Nome/Nome Empresarial\nEmail\n{n} SA\n.", "{n} SA"),
    (4, "name over mail", "nome / nome empresarial \n e-mail \n {n} \n.", "{n}"),
    (5, "name beside mail", "Nome / Nome Empresarial E-mail\n{n} SEGURANCA fin@x.com", "{n} SEGURANCA"),
    (5, "name beside mail", "Nome / Nome Empresarial Email\n{n} SA\n.", "{n} SA"),
    (5, "name beside mail", "Nome /Nome Empresarial e-mail\n {n} x_y@z.br", "{n}"),
    (7, "two lines", "EMITENTE DA NFS-e\nx:\nNome / Nome empresarial\n52.677.763 {n}\nARAUJO\nCNPJ / CPF / NIF", "{n} ARAUJO"),
    (7, "two lines", "EMITENTE DA NFS-e\nNome / Nome empresarial\n{n}\nTelefone", "{n}"),
    (7, "two lines", "EMITENTE\na:\nb:\nNome / Nome Empresarial\n1.2 {n}\n\n;", "{n}"),
    (8, "trade name", "Nome fantasia: {n}\n;", "{n}"),
    (8, "trade name", "NOME FANTASIA :{n}-A\n;", "{n}-A"),
    (8, "trade name", "Nome  fantasia: {n} & CIA\n;", "{n} & CIA"),
    (99, None, "; {c} ;", None),
    (99, None, "; R$ 1,00\n;", None),
    (99, None, "emissor: {c}", None),
)
NOTE_END = "\n;\n;\n;\n;\n;\n;\n;\n;\n;\n;\n"

#: Marks of documents: text, kind rank (0: none), marks against, slip marks, whether a key, a fiscal mark, an administrative word, an amount.
ADMIN_BLOCKS = (
    ("Lembrete gentil sobre o contrato", 1, 0, 0, 0, 0, 1, 0), ("Ordem  de\nServiço {c}", 2, 0, 0, 0, 0, 0, 0), ("segue o DISTRATO", 3, 0, 0, 0, 0, 0, 0), ("rescisão contratual", 4, 0, 0, 0, 0, 0, 0),
    ("Solicitação de encerramento", 5, 0, 0, 0, 0, 1, 0), ("NOTIFICAÇÃO AUTOMÁTICA", 6, 0, 0, 0, 0, 1, 0), ("GUIA - PROCESSO 123", 7, 0, 0, 0, 0, 0, 0), ("contrato master", 8, 0, 0, 0, 0, 0, 0),
    ("JULY 2024 INVOICE FOR SERVICES", 9, 0, 0, 0, 0, 0, 0), ("planilha de conferência", 10, 0, 0, 0, 0, 0, 0), ("CÂMBIO HBO", 11, 0, 0, 0, 0, 0, 0), ("Alvim Nogueira", 12, 0, 0, 0, 0, 0, 0),
    ("cobrança indevida", 13, 0, 0, 0, 0, 0, 0), ("reembolso de tarifas", 14, 0, 0, 0, 0, 0, 0), ("TARIFAS CSC", 15, 0, 0, 0, 0, 0, 0), ("Proposta comercial", 16, 0, 0, 0, 0, 0, 0), ("termo de adesão", 16, 0, 0, 0, 0, 0, 0),
    ("guia custas judiciais", 16, 0, 0, 0, 0, 0, 0), ("serviço público", 16, 0, 0, 0, 0, 0, 0), ("aviso", 0, 0, 0, 0, 0, 1, 0), ("AVISO geral", 0, 0, 0, 0, 0, 1, 0), ("comunicado", 0, 0, 0, 0, 0, 1, 0), ("sem nada", 0, 0, 0, 0, 0, 0, 0),
    ("R$ 1.234,56", 0, 0, 0, 0, 0, 0, 1), ("Vencimento: 01/02/2024", 0, 0, 1, 0, 0, 0, 1), ("CHAVE DE ACESSO", 0, 1, 0, 1, 1, 0, 0), ("Documento auxiliar", 0, 0, 0, 0, 1, 0, 0), ("protocolo de autorização", 0, 1, 0, 0, 2, 0, 0),
    ("Cedente", 0, 1, 1, 0, 0, 0, 0), ("Recibo do Sacado", 0, 2, 2, 0, 0, 0, 0), ("Tomador de serviços", 0, 1, 0, 0, 0, 0, 0), ("base de cálculo", 0, 1, 0, 0, 0, 0, 0), ("pagador", 0, 0, 1, 0, 0, 0, 0), ("valor a pagar", 0, 0, 1, 0, 0, 0, 0),
    ("12345678901234567890123456789012345678901234", 0, 1, 0, 1, 1, 0, 0), ("ICMS", 0, 1, 0, 0, 0, 0, 0),
)


def _filled(template, values: dict):
    parts, rest = [], template
    while rest:
        at = min((i for i in (rest.find(k) for k in values) if i >= 0), default=len(rest))
        parts += [F.lit(rest[:at])] if at else []
        key = next((k for k in values if rest.startswith(k, at)), "")
        parts += [values[key]] if key else []
        rest = rest[at + len(key):]
    return F.concat(*parts)


def _chosen(blocks, at, values):
    return F.element_at(F.array(*[_filled(b, values) if b is not None else F.lit(None).cast("string") for b in blocks]), at)


def _documents(spark, d, blocks, end):
    """Two blocks of each order's document; the company's name is words of a part."""
    o, p = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "part").select("p_partkey", "p_name")
    n = len(blocks)
    x = spread(o).join(p, F.col("o_custkey") % 200 == F.col("p_partkey"))
    values = {"{n}": F.upper("p_name"), "{m}": F.concat(F.lit("Maria "), F.lower("p_name")), "{c}": F.lpad(F.col("o_orderkey").cast("string"), 6, "0")}
    places = [(F.col("o_orderkey") % n + 1).cast("int"), ((F.col("o_orderkey") * 7 + F.floor(F.col("o_orderkey") / n)) % n + 1).cast("int")]
    return x.select("o_orderkey", F.concat(*[y for at in places for y in (_chosen([b[2] for b in blocks], at, values), F.lit(end))]).alias("text"))


def _blocks_sql(blocks) -> str:
    rows = ", ".join("({}, {}, {}, {})".format(i, b[0], *(f"'{x.replace(chr(39), chr(39) * 2)}'" if x else "NULL" for x in (b[1], b[3]))) for i, b in enumerate(blocks))
    n = len(blocks)
    return f"""WITH b(i, place, step, name) AS (VALUES {rows}),
d AS (SELECT o_orderkey, upper(p_name) AS n, o_orderkey % {n} AS i, (o_orderkey * 7 + o_orderkey // {n}) % {n} AS j FROM orders JOIN part ON o_custkey % 200 = p_partkey),
f AS (SELECT o_orderkey, n, b.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY b.place, seq) AS r FROM (SELECT o_orderkey, n, i AS block, 0 AS seq FROM d UNION ALL SELECT o_orderkey, n, j, 1 FROM d) JOIN b ON b.i = block)
SELECT o_orderkey, step, replace(replace(name, '{{n}}', n), '{{m}}', 'Maria ' || lower(n)) AS name FROM f WHERE r = 1"""


def slip_suppliers(spark, d):
    return _documents(spark, d, SLIP_BLOCKS, SLIP_END).select("o_orderkey", cascades.slip_supplier(F.col("text")).alias("s")).select("o_orderkey", "s.step", "s.name")


def note_suppliers(spark, d):
    own = F.array(F.lit("GRUPO PROPRIO S/A"), F.lit("OUTRA PROPRIA LTDA"))
    return _documents(spark, d, NOTE_BLOCKS, NOTE_END).select("o_orderkey", cascades.note_supplier(F.col("text"), own).alias("s")).select("o_orderkey", "s.step", "s.name")


def admin_documents(spark, d):
    """Three marks a document; which of them are administrative and of what subtype."""
    n, k = len(ADMIN_BLOCKS), F.col("o_orderkey")
    values = {"{c}": F.lpad(k.cast("string"), 6, "0")}
    places = [(k % n + 1), ((k * 5 + F.floor(k / n)) % n + 1), ((k * 11 + F.floor(k / 7)) % n + 1)]
    text = F.concat_ws("\n", *[_chosen([b[0] for b in ADMIN_BLOCKS], at.cast("int"), values) for at in places])
    x = admin.admin_fields(spread(table(spark, d, "orders")).select("o_orderkey", text.alias("text")))
    x = router.forms(x)
    return x.select("o_orderkey", admin.accepts(*[F.col(c) for c in (router.TEXT, router.BARE, router.FOLDED)]).alias("accepted"), "subtype")


SUBTYPES = ("LEMBRETE", "ORDEM_SERVICO", "DISTRATO", "RESCISAO", "ENCERRAMENTO", "NOTIFICACAO", "GUIA_JURIDICA", "CONTRATO", "INVOICE_INTERNACIONAL", "RELATORIO", "CAMBIO", "CONDOMINIO", "RECLAMACAO", "REEMBOLSO", "TARIFAS_INTERNAS", "ADMINISTRATIVO")
ADMIN_SQL = f"""WITH b(i, kind, against, slip, key, fiscal, word, money) AS (VALUES {", ".join(str((i, *b[1:])) for i, b in enumerate(ADMIN_BLOCKS))}),
d AS (SELECT o_orderkey, unnest([o_orderkey % {len(ADMIN_BLOCKS)}, (o_orderkey * 5 + o_orderkey // {len(ADMIN_BLOCKS)}) % {len(ADMIN_BLOCKS)}, (o_orderkey * 11 + o_orderkey // 7) % {len(ADMIN_BLOCKS)}]) AS block FROM orders),
e AS (SELECT DISTINCT o_orderkey, block FROM d),
s AS (SELECT o_orderkey, min(CASE WHEN kind > 0 THEN kind END) AS kind, sum(against) AS against, sum(slip) AS slip, max(key) AS key, max(fiscal % 2) AS fiscal, max(fiscal) AS disguised, max(word) AS word, max(money) AS money FROM e JOIN b ON b.i = block GROUP BY 1),
-- of two blocks that name the same thing one counts: a receipt's line holds the payer's word
t AS (SELECT s.*, CASE WHEN kind IS NOT NULL THEN disguised = 0 ELSE word > 0 AND money = 0 AND fiscal = 0 END AS good FROM s)
SELECT o_orderkey, key = 0 AND against < 2 AND slip < 3 AND good AS accepted, list_extract({list(SUBTYPES)}, coalesce(kind, 16)) AS subtype FROM t"""

QUERIES = {"slip_suppliers": slip_suppliers, "note_suppliers": note_suppliers, "admin_documents": admin_documents}
SQL = {"slip_suppliers": _blocks_sql(SLIP_BLOCKS), "note_suppliers": _blocks_sql(NOTE_BLOCKS), "admin_documents": ADMIN_SQL}
