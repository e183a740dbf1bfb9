"""Fields of documents whose vendor or layout is known: rule data in front of the general slip and note rules.

A vendor's fields come from its own ordered patterns, then from its fallback (largest or latest of all), then from the
general rules of the document's type. Everything is one expression a field, a CASE on the extractor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from . import fields
from .fields import AMOUNT, DAY

MONEY = r"\s*[:\-]?\s*(?:R\$)?\s*" + AMOUNT


@dataclass(frozen=True)
class Vendor:
    """supplier: constant name. number, amount, due: patterns in order. largest: amounts above it may be the fallback."""

    supplier: str | None = None
    number: tuple[str, ...] = ()
    amount: tuple[str, ...] = ()
    due: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 1e12
    largest: bool = False
    latest: bool = False
    weights: fields.Weights | None = None


# What speaks for an amount on three vendors' papers.
MUGO = fields.Weights(("TOTAL: R$", "VALOR TOTAL: R$", "TOTAL R$", "VALOR TOTAL R$", "VALOR A PAGAR", "VALOR DA FATURA", "DESCRIÇÃO VALOR TOTAL", "V. TOTAL", "V.TOTAL"), 10, (("TOTAL", 8, "V.UNIT"), ("VALOR TOTAL", 9, ""), ("V. TOTAL", 7, ""), ("V.TOTAL", 7, "")), 6)
PRO_PAINEL = fields.Weights(("VALOR DO DOCUMENTO", "VALOR", "TOTAL", "VALOR TOTAL", "VALOR A PAGAR"), 10, (("VALOR DO DOCUMENTO", 12, ""), ("TOTAL", 8, "")))
ACIMOC = fields.Weights(("VALOR DO DOCUMENTO", "VALOR", "VALOR A PAGAR", "VALOR DO BOLETO"), 2, more=False, pattern=r"R?\$?\s*(\d{1,3}(?:\.\d{3})*,\d{2})")
# vendors' names, and the labels of their layouts.
VENDORS = {
    "repromaq": Vendor("REPROMAQ COM. E IND. LTDA", (r"(?<![\d-])(\d{4}-\d)(?!\d)",), (r"valor\s+do\s+documento" + MONEY, r"valor\s+cobrado" + MONEY)),
    "gox": Vendor("GOX S.A.", (r"receber_(\d+)",), (r"total\s+a\s+pagar" + MONEY, r"R\$\s*" + AMOUNT, r"valor" + MONEY), latest=True),
    "emc": Vendor("EMC TECNOLOGIA LTDA", (r"fatura\s+(?:de\s+)?loca[çc][ãa]o\s+n?[º°]?\s*[:\-]?\s*(\d+)", r"n[º°]\s*[:\-]?\s*(\d{4,})"), (r"\btotal\s+R\$\s*" + AMOUNT, r"\btotal\b[^\d\n]*" + AMOUNT), largest=True),
    "net_center": Vendor("NET CENTER UNAI PROVEDOR DE INTERNET LTDA", (), (), (r"emiss[aã]o\s+vencim\s*ento[^\d]*\d{2}/\d{2}/\d{4}\s+(\d{2}/\d{2}/\d{4})",), largest=True),
    "tim": Vendor("TIM S.A.", (r"fatura\s+de\s+pagamento[:\s]*(\d+)", r"fatura[:\s]*(\d{7,})"), (r"R\$\s*" + AMOUNT, r"valor" + MONEY), (), 1.0, 100_000.0),
    "montes_claros": Vendor(None, (r"n[º°o]?\s*nfse\s*[:\-]?\s*(\d{12,20})", r"\bnfse\b[^0-9]{0,10}(\d{12,20})", r"(\d{4}[/\-]\d{1,6})"), (r"valor\s+dos\s+servi[çc]os" + MONEY, r"valor\s+l[íi]quido(?:\s+da\s+nota)?" + MONEY, r"valor\s+total" + MONEY)),
    "vila_velha": Vendor(None, (r"\d{2}:\d{2}:\d{2}\s+\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}\s+(\d+)", r"n[úu]mero[:\s]+(\d+)"), (r"valor\s+dos\s+servi[çc]os" + MONEY, r"valor\s+l[íi]quido" + MONEY, r"valor\s+total" + MONEY)),
    "comprovante": Vendor(None, (), (r"valor(?:\s+da\s+transfer[eê]ncia|\s+transferido)?" + MONEY, r"quantia" + MONEY, r"montante" + MONEY), (r"data(?:\s+da\s+transfer[eê]ncia)?\s*[:\-]?\s*" + DAY, r"(?:realizado|efetuado)\s+em\s*[:\-]?\s*" + DAY, DAY), largest=True),
    "utility": Vendor(None, (r"nota\s+fiscal\s*n[o°º]?\.?\s*[:\-]?\s*([0-9.\-]+)", r"fatura\s*n[°º]?\s*[:\-]?\s*([0-9.\-]+)"), (r"total\s+a\s+pagar" + MONEY,), (r"vencimento\s*[:\-]?\s*(\d{2}[/.]\d{2}[/.]\d{4})",), largest=True),
    "telcables": Vendor("TELCABLES BRASIL LTDA FILIAL SAO PAULO", (r"(?:nota\s+fiscal|nota|nf)\s+fatura\s*[:\-]?\s*0*(\d+)", r"fatura\s*[:\-]?\s*0*(\d+)"), (r"total\s+a\s+pagar" + MONEY, r"valor\s+total" + MONEY, r"total" + MONEY), largest=True),
    "acimoc": Vendor("ASSOCIAÇÃO COML. INDL. E SERVIÇOS DE MONTES CLAROS", (r"(?:n[úu]mero|documento|boleto)[:\s]+(\d{3,4}-\d{3,4})", r"\b(\d{3,4}-\d{3,4})\b", r"(?:n[úu]mero|documento)[:\s]+(\d{6,10})"), weights=ACIMOC),
    "mugo": Vendor("MUGO TELECOMUNICAÇÕES LTDA", (r"n[º°o]\s+(?:documento)?\s*[:]?\s*(\d{4,15})", r"fatura\s+n?[º°o]?\s*[:]?\s*(\d{4,15})", r"documento\s+n?[º°o]?\s*[:]?\s*(\d{4,15})"), weights=MUGO),
    "pro_painel": Vendor("PRÓ - PAINEL LTDA", (r"n\.?o:?\s*(\d{4,6})", r"documento\s*:?\s*(\d{4,10})", r"fatura\s*:?\s*(\d{4,10})"), weights=PRO_PAINEL),
    "tunna": Vendor("TUNNA ENTRETENIMENTO E AUDIOVISUAL LTDA", (r"fat/(\d+)", r"n\s*[^\w\s]?\s*[:.]\s*(\d{3}\.\d{3}\.\d{3})", r"(\d{3}\.\d{3}\.\d{3})"), (), (), 10.0, largest=True),
    "ufinet": Vendor("UFINET BRASIL S.A.", (r"fatura\s*(?:no\.?|n[º°]?|numero)?\s*:?\s*(\d+)",), (r"total\s*\(brl\)\s*:?\s*" + AMOUNT, r"total" + MONEY), (r"venc(?:imento)?\.?\s*:?\s*" + DAY,)),
    "csc": Vendor("CSC GESTAO INTEGRADA S/A", (), (r"valor\s+total" + MONEY, r"total" + MONEY), (), largest=True),
}


def with_vendor_fields(routed: DataFrame, text: str = "text") -> DataFrame:
    """Fields of every routed document: the vendor's where it has rules, else the general ones."""
    general = fields.extracted(routed, text)
    t, who = F.col(text), F.col("extractor")

    def case(make, default):
        branches = [(name, make(v)) for name, v in VENDORS.items()]
        out = None
        for name, value in branches:
            if value is not None:
                out = F.when(who == name, value) if out is None else out.when(who == name, value)
        return F.coalesce(out, default)

    def insensitive(patterns):
        return tuple("(?iu)" + p for p in patterns)

    def amount(v):
        parts = [fields.weighted_amount(t, v.weights)] if v.weights else []
        parts += [fields.first_amount(t, insensitive(v.amount), v.low, v.high)] if v.amount else []
        parts += [fields.largest_of(t, v.low, v.high)] if v.largest else []
        return F.coalesce(*parts) if parts else None

    def due(v):
        parts = [fields.first_match(t, insensitive(v.due), dates.parse_br)] if v.due else []
        parts += [F.coalesce(fields.first_day(t, (r"(?iu)venc(?:imento)?[:\s]+" + DAY,)), fields.latest_day(t))] if v.latest else []
        return F.coalesce(*parts) if parts else None

    return general.withColumns({
        "fornecedor_nome": case(lambda v: F.lit(v.supplier) if v.supplier else None, F.col("fornecedor_nome")),
        "numero": case(lambda v: fields.first_match(t, insensitive(v.number)) if v.number else None, F.col("numero")),
        "valor": case(amount, F.col("valor")),
        "vencimento": case(due, F.col("vencimento"))})
