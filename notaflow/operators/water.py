"""Water bills that come as a mail's body, without attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, money

# Senders and subjects of the utility, its name and number.
SENDERS = ("sabesp.com.br", "fatura_sabesp", "fatura.sabesp", "noreply@sabesp")
SUBJECTS = ("sabesp", "fatura por e-mail", "sua fatura digital")
NAME, CNPJ = "SABESP", "43.776.517/0001-80"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def is_water_mail(subject: Column, sender: Column, body: Column) -> Column:
    """By sender, subject, the utility's name beside a supply, or three of the four labels of its bills."""
    low = F.lower(F.coalesce(body, F.lit("")))
    labels = sum((F.contains(low, F.lit(w)).cast("int") for w in ("fornecimento", "unidade", "vencimento", "valor")), F.lit(0))
    return _any(sender, SENDERS) | _any(subject, SUBJECTS) | (F.contains(low, F.lit("sabesp")) & F.contains(low, F.lit("fornecimento"))) | (labels >= 3)


def _labelled(body: Column, label: str, value: str) -> Column:
    """What follows a label, bold or plain."""
    return F.coalesce(*[F.nullif(F.regexp_extract(body, rf"(?iu){label}{after}{value}", 1), F.lit("")) for after in (r"[:\s]*</b>\s*", r"[:\s]+")])


def water_bill(body: Column) -> Column:
    """struct<valor, vencimento, numero_documento, linha_digitavel, observacoes, fornecedor_nome, cnpj, doc_type, subtype>."""
    amount = F.coalesce(_labelled(body, "Valor", r"R\$\s*([\d.]+,\d{2})"), F.nullif(F.regexp_extract(body, r"R\$\s*([\d.]+,\d{2})", 1), F.lit("")))
    value = money.parse_br(amount)
    code = F.coalesce(*[F.nullif(F.regexp_extract(body, rf"(?isu)c[óo]digo\s+de\s+barras{after}([\d\s]{{40,60}})", 1), F.lit("")) for after in (r"[:\s]*</b>?\s*<br>?\s*", r"[:\s]+")])
    bare = F.regexp_replace(code, r"\s+", "")
    unit = F.trim(_labelled(body, "Unidade", r"([A-Z\s]+?)(?:<|$|\n)"))
    return F.struct(
        F.when(value > 0, value).alias("valor"), dates.parse_br(_labelled(body, "Vencimento", r"(\d{2}/\d{2}/\d{4})")).alias("vencimento"), _labelled(body, "Fornecimento", r"(\d{10,20})").alias("numero_documento"),
        F.when(F.length(bare) >= 44, bare).otherwise(F.trim(F.regexp_replace(code, r"\s+", " "))).alias("linha_digitavel"), F.when(F.length(unit) >= 3, F.concat(F.lit("Unidade: "), F.upper(unit))).alias("observacoes"),
        F.lit(NAME).alias("fornecedor_nome"), F.lit(CNPJ).alias("cnpj"), F.lit("UTILITY_BILL").alias("doc_type"), F.lit("WATER").alias("subtype"))
