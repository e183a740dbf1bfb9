"""Administrative documents: reminders, orders, terminations, guides, contracts, reports and the like.

A document is one if none of the fiscal marks speak against it and a phrase of the table occurs, or an administrative
word without an amount, a due date or a fiscal mark. Phrases are looked up in one pass over the folded text (upper case, no
accents, single blanks); what is no plain phrase is a pattern over the text with its lines. The subtype decides which fields
are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fixed, ids, money
from ..functions.phrases import folded, has_any, hits
from ..functions.text import strip_accents
from .fields import amount_of, first_match

BARE, FOLDED = "_bare", "_folded"
PHRASES = {p: kind for kind, phrases in fixed.ADMIN_KINDS.items() for p in phrases}
#: Subtypes whose amounts, and due dates, are read.
PAID, LISTED, DUE = ("CONTRATO", "RECLAMACAO", "INVOICE_INTERNACIONAL", "GUIA_JURIDICA", "ORDEM_SERVICO"), ("CONTRATO", "GUIA_JURIDICA", "RECLAMACAO", "ORDEM_SERVICO"), ("LEMBRETE", "CONTRATO", "CONDOMINIO", "GUIA_JURIDICA", "ORDEM_SERVICO")


def shape(*patterns: str) -> str:
    """One pattern of several, their blanks any white space."""
    return "|".join(p.replace(" ?", r"\s*").replace(" ", r"\s+") for p in patterns)


def _count(text: Column, shapes) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(shape(p)).cast("int") for p in shapes])


def _fiscal(text: Column) -> Column:
    return has_any(text, ("CHAVE DE ACESSO", "DOCUMENTO AUXILIAR", "NOTA FISCAL FATURA")) | text.rlike(r"\b\d{44}\b")


def accepts(text: Column, plain: Column, form: Column) -> Column:
    """Whether a text is an administrative document. plain: the text in upper case without accents; form: folded."""
    against = F.size(hits(form, fixed.ADMIN_NOT)) + _count(plain, fixed.ADMIN_NOT_SHAPES)
    key = F.contains(form, F.lit("CHAVE DE ACESSO")) | form.rlike(r"\b\d{44}\b")
    slip = F.size(hits(form, fixed.ADMIN_SLIP)) >= 3
    phrase = has_any(form, PHRASES) | plain.rlike(shape(*(p for shapes in fixed.ADMIN_SHAPES.values() for p in shapes)))
    disguised = _fiscal(form) | F.contains(form, F.lit("PROTOCOLO DE AUTORIZACAO"))
    word = has_any(F.upper(F.coalesce(text, F.lit(""))), fixed.ADMIN_WORDS)
    billed = F.coalesce(text, F.lit("")).rlike(r"\b\d{1,3}(?:\.\d{3})*,\d{2}\b") | plain.rlike(r"VENCIMENTO.*\d{2}/\d{2}/\d{4}") | _fiscal(form)
    return (F.length(form) > 0) & ~key & (against < 2) & ~slip & F.when(phrase, ~disguised).otherwise(word & ~billed)


def kinds(plain: Column, form: Column) -> Column:
    """All kinds whose phrases or patterns occur, in the order of the table."""
    names = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    by_phrase = F.transform(hits(form, PHRASES), lambda p: F.try_element_at(names, p))
    by_shape = F.array(*[F.when(plain.rlike(shape(*shapes)), F.lit(kind)) for kind, shapes in fixed.ADMIN_SHAPES.items()])
    order = list(dict.fromkeys([*fixed.ADMIN_KINDS, *fixed.ADMIN_SHAPES]))
    return F.array_intersect(F.array(*map(F.lit, order)), F.concat(by_phrase, by_shape))


def subtype(plain: Column) -> Column:
    return F.coalesce(*[F.when(plain.rlike(shape(p)), F.lit(name)) for name, _, p in fixed.ADMIN_SUBTYPES], F.lit("ADMINISTRATIVO"))


def _supplier(text: Column, kind: Column) -> Column:
    """The sender of a letter, else a name in capitals before a tax number, a known vendor of an order, a line that is a company."""
    name = r"[A-ZÀ-ÿ][A-ZÀ-ÿ0-9\s.\-&,()]"
    sender = F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?im)(?:^|\n)\s*(?:De|From)[:\s]+\s*({name}{{10,80}})(?:\n|$)", 1)), r"\s+", " ")
    sender = F.when(~F.upper(sender).rlike("CNPJ|CPF") & (F.length(sender) > 5), sender)
    before = F.trim(F.regexp_replace(F.regexp_extract(text, rf"({name}{{10,80}}?)(?:\s+(?:CNPJ|CPF)[:\s]*|\s+{ids.CNPJ})", 1), r"\s+", " "))
    known = F.when(kind == "ORDEM_SERVICO", F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for p, n in fixed.ORDER_SUPPLIERS]))
    line = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?m)^\s*({name}{{10,80}}(?:LTDA|S\.?A\.?|ME|EIRELI|-ME))\s*$", 1), r"\s+", " "))
    found = F.coalesce(sender, F.when(F.length(before) > 5, before), known, F.nullif(line, F.lit("")))
    # A contact's heading is no supplier.
    return F.when(~found.rlike(r"(?i)^Contato\s+(?:Comercial|T[eé]cnico)"), found)


def _due(text: Column, kind: Column) -> Column:
    day = r"(\d{2}/\d{2}/\d{4})"
    near = F.coalesce(ids.found(text, r"(?i)\bVENCIMENTO\b\s*[:\-–]?\s*" + day, 1), ids.found(text, r"(?is)\bVENCIMENTO\b.{0,50}?" + day, 1))
    rows = F.split(text, "\n")
    at = F.get(F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(r"(?i)\bVENCIMENTO\b"), i)), lambda i: i.isNotNull()), F.lit(0))
    around = F.coalesce(*[ids.found(F.coalesce(F.get(rows, F.greatest(at + d, F.lit(0))), F.lit("")), day, 1) for d in (0, 1, -1)])
    return dates.parse_br(F.coalesce(near, F.when(kind == "ORDEM_SERVICO", around)))


def _issued(text: Column) -> Column:
    """The first date that isn't beside a tax number: those and what is 20 characters around them is blanked first."""
    free = F.regexp_replace(text, rf"(?s).{{0,20}}{ids.CNPJ}.{{0,20}}", " ")
    return dates.parse_br(ids.found(free, r"\b(\d{2}/\d{2}/\d{4})\b", 1))


NUMBERS = (r"(?i)Documento\s*[:\-]?\s*(\d{6,9})\b", r"(?i)Processo\s*(?:n[º°.]?\s*)?[:\-]?\s*(\d{5,12})\b", r"(?i)(?:N[º°.]?\s*)?[:\-]?\s*(\d+-\d+)\b", r"(?i)CONTRATO\s*[:\-]?\s*([A-Z]{2}-?\d{4}-?\d{3,4})\b",
           r"(?i)Processo\s*[:\-]?\s*(\d{5}\.\d{3}\.\d{3}\.\d{4})\b", r"(?i)(?:Documento|N[º°.]?|ORDEM)\s*[:\-]?\s*([A-Z0-9\-.]+)\b")


def admin_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df with subtype, admin_type, admin_kinds, fornecedor_nome, cnpj, valor, vencimento, data_emissao, numero."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumns({BARE: strip_accents(F.upper(t)), FOLDED: folded(t)}).withColumn("subtype", subtype(F.col(BARE)))
    kind, names = F.col("subtype"), F.create_map(*[F.lit(x) for n, told, _ in fixed.ADMIN_SUBTYPES for x in (n, told)])
    near = first_match(t, (r"(?i)VALOR\s+(?:DO\s+)?(?:CONTRATO|PROCESSO|GUIA)\s*[:\-–]?\s*R\$\s*([\d.,]+)", r"(?i)VALOR\s+TOTAL\s*[:\-–]?\s*R\$\s*([\d.,]+)", r"(?i)TOTAL\s*[:\-–]?\s*R\$\s*([\d.,]+)", r"\bR\$\s*([\d.]+,\d{2})\b"), amount_of, lambda v: v > 0)
    listed = F.array_max(F.filter(money.amounts(t), lambda v: v > 10))
    return d.withColumns({
        "admin_type": F.coalesce(F.try_element_at(names, kind), F.lit("Documento administrativo")), "admin_kinds": kinds(F.col(BARE), F.col(FOLDED)), "fornecedor_nome": _supplier(t, kind), "cnpj": ids.cnpj(t),
        "valor": F.coalesce(F.when(kind.isin(*PAID), near), F.when(kind.isin(*LISTED), listed), F.lit(0.0)), "vencimento": F.when(kind.isin(*DUE), _due(t, kind)), "data_emissao": _issued(t),
        "numero": first_match(t, NUMBERS, None, lambda n: (F.length(n) >= 5) & n.rlike(r"[^A-Za-zÀ-ÿ]"))}).drop(BARE, FOLDED)
