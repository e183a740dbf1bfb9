"""What a line of a document is: an amount, a slip's digits, an address, noise, a supplier's name; and bank fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .ids import digits, found

MONEY = r"\b\d{1,3}(?:\.\d{3})*,\d{2}\b"


def _has(text: Column, *words: str) -> Column:
    """Whether one of the words is in the text."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _begins(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?U)^(?:" + "|".join(p.removeprefix("^") for p in patterns) + ")")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def currency_line(line: Column) -> Column:
    """A line of amounts: a currency sign, or an amount beside a date or the word REAL."""
    s = F.coalesce(line, F.lit(""))
    up = F.upper(s)
    return _has(up, "R$") | (s.rlike(MONEY) & (up.rlike(r"\bREAL\b") | s.rlike(r"\b\d{2}/\d{2}/\d{4}\b")))


def digit_line(line: Column) -> Column:
    """A slip's digit line: three dotted or spaced groups, or 40 digits and more that are most of the line."""
    s = F.coalesce(line, F.lit(""))
    n = F.length(digits(s))
    return s.rlike(r"\d{5}[.\s]\d{5}\s+\d{5}[.\s]\d{6}\s+\d{5}[.\s]\d{6}") | ((n >= 40) & (n > F.length(s) * 0.6))


def address_line(line: Column) -> Column:
    up = F.upper(F.coalesce(line, F.lit("")))
    return _begins(up, fixed.ADDRESS_BEGINS) | _any(up, fixed.ADDRESS_PARTS)


def noise_line(line: Column) -> Column:
    """Empty, one or two digits, or a currency sign alone."""
    return F.trim(F.coalesce(line, F.lit(""))).rlike(r"(?i)^(?:\d{1,2}|R?\$?)$")


def invalid_goods_supplier(name: Column) -> Column:
    """A captured supplier that is a label, a heading, a key or a piece of an address; also one of less than 3 characters."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(bare) < 3) | _begins(F.upper(bare), fixed.NO_GOODS_SUPPLIER)


def valid_comm_supplier(text: Column) -> Column:
    """A supplier's name on an invoice for communication services."""
    t = F.trim(F.coalesce(text, F.lit("")))
    up = F.upper(t)
    head = _has(up, "DOCUMENTO AUXILIAR", "COMUNICAÇÃO ELETRÔNICA", "COMUNICACAO ELETRONICA") | (_has(up, "NOTA FISCAL FATURA") & _has(up, "SERVIÇO"))
    street = up.rlike("^(?:" + "|".join(w.replace(".", r"\.") for w in fixed.STREETS) + ")")
    number = t.rlike(r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$") | F.translate(t, "./-", "").rlike(r"^\d{14,}$")
    words = F.size(F.split(t, r"\s+"))
    return (F.length(t) >= 3) & ~head & ~street & ~number & (_has(up, *fixed.COMPANY_WORDS) | ((words >= 2) & (F.length(t) >= 5)))


def name_before_cnpj(line: Column, cnpj: Column) -> Column:
    """The name on the left of a tax number on its line, labels taken out; null where there is none of 5 characters."""
    at = F.instr(F.coalesce(line, F.lit("")), F.coalesce(cnpj, F.lit("\u0000")))
    left = F.trim(F.regexp_replace(F.substring(line, F.lit(1), at - 1), r"(?i)[-–]?\s*CNPJ\s*$", " "))
    left = F.regexp_replace(left, r"(?iu)\b(?:" + "|".join(fixed.SLIP_LABELS) + r")\b", " ")
    name = F.trim(found(F.trim(F.regexp_replace(left, r"\s+", " ")), r"([A-ZÀ-ÿ][A-ZÀ-ÿ\s&.\-/]{5,160})\s*$", 1))
    return F.when((at > 0) & (F.length(cnpj) > 0) & (F.length(name) >= 5), name)


def bank_name(text: Column, line: Column) -> Column:
    """Bank of a slip: its line's first three digits, else a code in the text; BANCO_xxx for an unknown code."""
    code = F.coalesce(F.nullif(F.substring(line, 1, 3), F.lit("")), found(text, r"(?iu)(?:Banco|C[oó]digo\s+Banco)[^\d]*(\d{3})", 1))
    names = F.create_map(*[F.lit(x) for pair in fixed.BANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("BANCO_"), code))


def _account(text: Column, pattern: str, least: int) -> Column:
    """Number and check digit of the pattern's first match, joined by '-'; null if the number is shorter than `least`."""
    number = digits(F.regexp_extract(text, pattern, 1))
    check = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return F.when(F.length(number) >= least, F.concat_ws("-", number, check))


def agency(text: Column) -> Column:
    return F.coalesce(_account(text, r"(?iu)Ag[eê]ncia[^\d]*([\d.\s]{2,15})\s*[-–]?\s*(\d)?", 1), _account(text, r"(?iu)Ag[.\s]*[:\s]*([\d.\s]{2,15})\s*[-–]?\s*(\d)?", 1))


def account(text: Column) -> Column:
    return F.coalesce(*[_account(text, rf"(?i){label}[^\d]*(\d{{1,12}})[\s\-]?(\d)?", 4) for label in (r"Conta\s+Corrente", "C/?C", "Conta")])


def notice(link: Column, code: Column, number: Column, longest: int = 100) -> Column:
    """What a mail without attachments is listed with; null if there is nothing but the mark."""
    shown = F.when(F.length(link) <= longest, link).otherwise(F.concat(F.left(link, F.lit(longest - 3)), F.lit("...")))
    label = F.when(F.contains(link, F.lit("click.omie.com.br")), F.lit("Link (Omie): ")).otherwise(F.lit("Link: "))
    parts = [F.nullif(x, F.lit("")) for x in (link, code, number)]
    told = F.concat_ws(" | ", F.lit("[SEM ANEXO]"), F.when(parts[0].isNotNull(), F.concat(label, shown)), F.concat(F.lit("Código: "), parts[1]), F.concat(F.lit("NF: "), parts[2]))
    return F.when(F.coalesce(*parts).isNotNull(), told)
