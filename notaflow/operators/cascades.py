"""Ordered cascades of rules for a name in a text: the first candidate that passes wins.

A rule yields candidates, an array in page order, out of the text or its lines: the lines under a start line as far as a
reach and up to a stop line, the best-ranked lines of a shape, or the hits of a pattern in the text. A candidate carries
what it must pass. One fold walks the rules in order and in it one walks a rule's candidates until one passes, so that the
cleaning and the tests stand in the plan once, not once a rule, and nothing after the first success is evaluated.
Rules are data; the two cascades of the business follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, ids, lines, names
from ..functions.phrases import bare, has_any
from ..functions.text import for_extraction, let

CNPJ, CPF = ids.CNPJ, ids.CPF
LOOSE_CNPJ = r"\d{2}\D?\d{3}\D?\d{3}\D?\d{4}\D?\d{2}"
CANDIDATE = "array<struct<raw:string,shown:string,tests:int,least:int>>"

# What a candidate must pass, one bit each.
CLEAN, NO_LABEL, NO_ADDRESS, NO_AMOUNT, COMPANY, NOT_OWN = 1, 2, 4, 8, 16, 32

LABELS = tuple(dict.fromkeys([*fixed.LABEL_WORDS_BOTH, *map(bare, fixed.LABEL_WORDS_BOTH), *fixed.LABEL_WORDS, *(f"{a}{s}{b}" for a, b in (("/", ")"), ("/ ", "")) for s in fixed.LABEL_STATES)]))


def label_like(text: Column) -> Column:
    """Whether a text is a heading, a label or a piece of an address rather than a name; so is an empty one."""
    up = F.upper(F.coalesce(text, F.lit("")))
    code = up.rlike(r"\b(?=[0-9A-F]*\d)(?=[0-9A-F]*[A-F])[0-9A-F]{9}\b")  # a verification code's piece
    return (up == "") | has_any(up, LABELS) | code | up.rlike(r"^\s*[A-Z]{2}\s+CNPJ\s*$") | up.rlike(r"^(?:BENEFICI[ÁA]RIO)\S")


def candidates(raws: Column, tests: int, least: int = 5, shown=None) -> Column:
    """An array of raw names as candidates. shown: what a candidate is returned as, if not its cleaned name."""
    return F.transform(raws, lambda r: F.struct(r.alias("raw"), (shown(r) if shown else F.lit(None).cast("string")).alias("shown"), F.lit(tests).alias("tests"), F.lit(least).alias("least"))).cast(CANDIDATE)


def stripped(text: Column) -> Column:
    """Without blanks and line ends around."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one(raw: Column) -> Column:
    return F.filter(F.array(raw), lambda r: r.isNotNull())


def hits(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def hits_where(text: Column, sign: str, pattern: str) -> Column:
    """hits, where a sign without which there is none is in the text: it is found faster than the whole pattern fails."""
    return F.when(text.rlike(sign), hits(text, pattern)).otherwise(F.array().cast("array<string>"))


def places(rows: Column, pattern: str) -> Column:
    """Numbers of the lines that match."""
    every = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.get(rows, i).rlike(pattern))


def under(rows: Column, at: Column, reach: int, stop: str = "") -> Column:
    """The lines after line `at`, at most `reach` and up to the first that matches `stop`."""
    window = F.slice(rows, at + 2, F.lit(reach))
    if not stop:
        return window

    def cut(w: Column) -> Column:
        return let(F.get(places(w, stop), F.lit(0)), lambda ends: F.when(ends.isNotNull(), F.slice(w, F.lit(1), ends)).otherwise(w))

    return let(window, cut)


def lines_of(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def solid_lines(text: Column) -> Column:
    return F.filter(lines_of(text), lambda x: x != "")


def shown_with_number(parts: Column) -> Column:
    """'NAME - CNPJ n' of a line 'NAME - CNPJ: n'."""
    name = F.regexp_replace(F.regexp_extract(parts, rf"(?iU)^\s*(.+?)\s*[-–]\s*CNPJ\s*[:-]?\s*({CNPJ})", 1), r"\s+", " ")
    return F.concat(F.regexp_replace(name, r"^[ -]+|[ -]+$", ""), F.lit(" - CNPJ "), F.regexp_extract(parts, rf"({CNPJ})\b", 1))


@dataclass(frozen=True)
class Rule:
    """A step of a cascade: its name, and candidates(text, lines, solid lines)."""

    name: str
    candidates: object


def first_passing(text: Column, rules: tuple[Rule, ...], own: Column | None = None, cleaned=names.entity_name) -> Column:
    """(step, name) of the first candidate that passes; null if none does. own: names of the user's companies, upper case."""
    def asks(c: Column, bit: int) -> Column:
        return c["tests"].bitwiseAND(bit) > 0

    def passed(c: Column) -> Column:
        name = F.when(asks(c, CLEAN), cleaned(c["raw"])).otherwise(stripped(c["raw"]))

        def judged(pair: Column) -> Column:
            n = pair["name"]
            ok = F.length(n) >= c["least"]
            ok = ok & ~(asks(c, NO_LABEL) & label_like(n)) & ~(asks(c, NO_ADDRESS) & lines.address_line(n)) & ~(asks(c, NO_AMOUNT) & lines.currency_line(c["raw"]))
            ok = ok & (~asks(c, COMPANY) | (c["raw"].rlike("(?i)LTDA|S\\.?A\\.?|S/A|EIRELI|ME|EPP")) | (c["raw"].rlike("^[A-ZÀ-ÿ]") & ~lines.address_line(c["raw"])))
            if own is not None:
                ok = ok & ~(asks(c, NOT_OWN) & is_own(n, own))
            return F.when(ok, F.coalesce(c["shown"], n))

        return let(F.struct(name.alias("name")), judged)

    steps = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.name)])

    def walked(at: Column) -> Column:
        def of(k: Column) -> Column:
            every = F.coalesce(*[F.when(k == i, r.candidates(at["text"], at["rows"], at["solid"])) for i, r in enumerate(rules)])
            name = F.aggregate(every, F.lit(None).cast("string"), lambda found, c: F.coalesce(found, passed(c)))
            return let(name, lambda n: F.when(n.isNotNull(), F.struct(F.try_element_at(steps, k).alias("step"), n.alias("name"))))

        nothing = F.lit(None).cast("struct<step:string,name:string>")
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), nothing, lambda found, k: F.coalesce(found, of(k)))

    return let(F.struct(text.alias("text"), lines_of(text).alias("rows"), solid_lines(text).alias("solid")), walked)


FORM = r"\s*(?:LTDA|S/?A|EIRELI|ME|EPP|S\.A\.?|-\s*ME|-\s*EPP)\s*$"


def is_own(name: Column, own: Column) -> Column:
    """Whether a name is one of the user's companies: alike without the form of company, or one within the other from 10 letters on."""
    def core(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.trim(F.substring_index(F.upper(x), "(", 1)), "(?iU)" + FORM, ""))

    n = F.trim(F.regexp_replace(F.trim(F.upper(name)), "(?iU)" + FORM, ""))
    return (n != "") & F.exists(F.transform(own, core), lambda o: (o != "") & ((o == n) | ((F.length(n) >= 10) & F.contains(o, n)) | ((F.length(o) >= 10) & F.contains(n, o))))


# ---- slips

NAME = r"[A-ZÀ-ÿ][A-ZÀ-ÿ\s&.\-]{5,120}"
PERSON = r"[A-ZÀ-ÿ][A-Za-zÀ-ÿ\s]{5,60}?"
PLAIN_NAME = CLEAN | NO_LABEL | NO_ADDRESS


def payee_number(text: Column) -> Column:
    """Tax number of a slip's payee: a company's or person's after the label, else the first company's."""
    return F.coalesce(*[ids.found(text, rf"(?i){label}.*?({number})", 1) for number in (CNPJ, CPF) for label in ("Benefici[aá]rio", "Cedente")], ids.cnpj(text))


def payee_person(text: Column) -> Column:
    return F.coalesce(*[ids.found(text, rf"(?i){label}({CPF})", 1) for label in (r"Benefici[aá]rio.*?", r"Cedente.*?", r"CPF[:\s]+")])


def _alone_label(text, rows, solid):
    """A line that is only the label; a name within seven lines, codes and fixed words passed over."""
    def names_under(i):
        good = F.filter(under(rows, i, 7), lambda x: ~x.rlike(r"(?i)^\d{3}-\d$|^Autentica|^\d{5}\.\d{5}") & (F.length(x) >= 5) & ~label_like(x) & ~lines.currency_line(x))
        return good

    return candidates(F.flatten(F.transform(places(rows, r"(?i)^Cedente\s*$"), names_under)), CLEAN | COMPANY)


def _on_behalf(text, rows, solid):
    """'A a serviço de B - CNPJ n', returned with the number."""
    got = hits_where(text, r"(?iU)\ba\s+servi[cç]o\s+de\s", rf"(?imU)^\s*(.+?\ba\s+servi[cç]o\s+de\s+.+?\s*[-–]\s*CNPJ\s*[:-]?\s*{CNPJ})\b")
    return candidates(F.slice(got, 1, 1), 0, 0, shown_with_number)


def _named_with_number(text, rows, solid):
    """'NAME - CNPJ n' lines that aren't the payer's; one with a form of company before the others."""
    got = hits_where(text, rf"(?iU)[-–]\s*CNPJ\s*[:-]?\s*{CNPJ}\b", rf"(?imU)^\s*([^\n]{{5,220}}?\s*[-–]\s*CNPJ\s*[:-]?\s*{CNPJ})\b")
    before = F.transform(got, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, rf"(?iU)^(.*?)\s*[-–]\s*CNPJ\s*[:-]?\s*{CNPJ}$", 1).alias("name")))
    good = F.filter(before, lambda b: ~lines.digit_line(b["name"]) & b["name"].rlike("[A-ZÀ-ÿ]") & ~F.contains(F.upper(b["name"]), F.lit("CSC")) & ~lines.currency_line(b["name"]))
    company = r"(?i)\bS/?A\b|\bLTDA\b"
    formed, other = F.filter(good, lambda b: b["name"].rlike(company)), F.filter(good, lambda b: ~b["name"].rlike(company))
    return candidates(F.transform(F.slice(F.concat(formed, other), 1, 1), lambda b: b["line"]), 0, 0, shown_with_number)


def _before_number(text, rows, solid):
    found = let(payee_number(text), lambda n: F.transform(F.filter(rows, lambda x: F.contains(x, n)), lambda x: lines.name_before_cnpj(x, n)))
    return candidates(F.filter(found, lambda n: n.isNotNull()), PLAIN_NAME)


def _under_payee(text, rows, solid):
    """Each line with the label: a name before a number on it, then the next four lines up to the payer's."""
    def of(i):
        return let(F.get(solid, i), lambda row: at(i, row))

    def at(i, row):
        inline = one(lines.name_before_cnpj(row, ids.cnpj(row)))
        same = F.slice(hits(row, rf"({NAME})\s+{CNPJ}\b"), 1, 1)
        below = F.transform(under(solid, i, 4, r"(?i)\bPagador\b"), lambda x: F.concat(
            candidates(F.slice(hits(x, rf"^\s*({NAME})\s+{CNPJ}\b"), 1, 1), PLAIN_NAME), candidates(F.array(x), PLAIN_NAME | NO_AMOUNT, 8)))
        return F.concat(candidates(inline, PLAIN_NAME), candidates(same, PLAIN_NAME), F.flatten(below))

    return F.flatten(F.transform(places(solid, r"(?iU)\bBenefici[aá]rio\b"), of))


def _final_payee(text, rows, solid):
    return candidates(F.slice(hits(text, rf"(?i)Benefici[aá]rio\s+final\s+({NAME})\s+{CNPJ}\b"), 1, 1), PLAIN_NAME)


def _after_number(text, rows, solid):
    """In the 100 characters after the payee's number."""
    after = F.regexp_extract(text, rf"(?s)(?i:Benefici[aá]rio)[^\n]*?{CNPJ}(.{{0,100}})", 1)
    return candidates(one(ids.found(after, r"([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][A-Za-zÀ-ÿ\s&.\-]{5,80})", 1)), PLAIN_NAME)


def _person(text, rows, solid):
    """A person's name before its number, or after a label and before the number."""
    cut = let(payee_person(text), lambda n: F.transform(F.filter(rows, lambda x: F.contains(x, n)), lambda x: F.trim(F.substring(x, F.lit(1), F.instr(x, n) - 1))))
    cut = F.coalesce(cut, F.array().cast("array<string>"))
    bare_name = F.transform(cut, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^.*?(?:Benefici[aá]rio|Cedente|CPF|Nome)[:\s]*", ""), r"^[ \-:|]+|[ \-:|]+$", ""))
    labelled = [F.slice(hits(text, p), 1, 1) for p in (rf"(?i)Benefici[aá]rio\s+({PERSON})\s+(?:CPF|CPF/CNPJ)[:\s]*{CPF}", rf"(?i)Cedente\s+({PERSON})\s+{CPF}")]
    every = candidates(F.concat(F.filter(bare_name, lambda n: F.length(n) >= 5), *labelled), PLAIN_NAME)
    return F.when(payee_person(text).isNotNull(), every).otherwise(F.array().cast(CANDIDATE))


SLIP = (
    Rule("label alone", _alone_label), Rule("on behalf", _on_behalf), Rule("name with number", _named_with_number), Rule("before number", _before_number),
    Rule("under payee", _under_payee), Rule("final payee", _final_payee), Rule("after number", _after_number), Rule("person", _person),
)


def slip_supplier(text: Column) -> Column:
    """(step, name) of a slip's payee."""
    return first_passing(F.coalesce(text, F.lit("")), SLIP)


# ---- service notes

COMPANY_END = r"(?:LTDA|S/?A|EIRELI|ME|EPP)"
WORDS = r"[A-ZÀ-ÿ][A-Za-zÀ-ÿ0-9\s&.\-]"
BEFORE_MAIL = r"\s+[a-zA-Z0-9_.+-]+@.*$"
# Labels that end a name of two lines, and what no name begins with.
NEXT_LABEL = r"(?iU)^(?:CNPJ|CPF|NIF|Inscri[çc][ãa]o|Telefone|Endere[çc]o|E-?mail|Munic[íi]pio|CEP|Simples|Regime|TOMADOR|INTERMEDIÁRIO)"
FIELD_LABEL = r"(?iU)^(?:Endere[çc]o|Munic[íi]pio|UF|CPF|CNPJ|Inscri[çc][ãa]o|E-?mail|Telefone)\s*:"
NO_NOTE_NAME = r"(?iU)^(?:Prestador\s+de\s+Servi[çc]os$|Nome$|E-mail$|Email$|Fantasia$|Nome\s+Fantasia$|Nome/NomeEmpresarial$|Nome\s+Empresarial|Telefone$|Endere[çc]o$)"


def _first_hit(pattern: str, least: int = 5, refuse: str = "", clean=None):
    """Candidates of the first hit of a pattern, unless it begins with what is refused."""
    def of(text, rows, solid):
        got = F.slice(hits(text, pattern), 1, 1)
        if clean:
            got = F.transform(got, clean)
        return candidates(F.filter(got, lambda n: ~stripped(n).rlike(refuse)) if refuse else got, NOT_OWN, least)

    return of


def _provider_section(text, rows, solid):
    """The section's heading, the name's label within nine lines, and a company or capitals within nine more."""
    def of(i):
        below = let(F.get(places(under(rows, i, 9), r"(?iU)^Nome/Raz[ãa]o\s+Social\s*:\s*$"), F.lit(0)), lambda label: under(rows, i + 1 + label, 9))
        seen = F.filter(below, lambda x: (x != "") & ~x.rlike(FIELD_LABEL) & ~x.rlike(r"^\d{2}\.\d{3}\.\d{3}[/-]|^\d[\d.\-]+$"))
        good = F.filter(seen, lambda x: x.rlike(r"(?i)(?:LTDA|S\.?A\.?|S/A|EIRELI|ME|EPP)$") | (x.rlike(r"^[A-ZÀ-ÿ][A-ZÀ-ÿ\s&.\-]+$") & (F.length(x) >= 10) & ~x.rlike(r"(?iU)^(?:RUA|AV|AVENIDA|PRA[ÇC]A|RODOVIA|ESTRADA)\s")))
        return F.coalesce(good, F.array().cast("array<string>"))

    return candidates(F.flatten(F.transform(F.slice(places(rows, r"(?iU)^PRESTADOR\s+DE\s+SERVI[ÇC]OS\s*$"), 1, 1), of)), NOT_OWN, 1)


def _two_lines(text, rows, solid):
    """In the issuer's section, the name under its label, with the next line where that is no label."""
    def of(i):
        above = F.transform(F.slice(rows, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), F.upper)
        section = F.get(F.filter(F.transform(above, lambda x: F.when(F.contains(x, F.lit("EMITENTE")), True).when(F.contains(x, F.lit("TOMADOR")), False)), lambda v: v.isNotNull()), F.lit(0))
        name, more = F.regexp_replace(F.get(rows, i + 1), r"^[\d.]+\s+", ""), F.get(rows, i + 2)
        full = F.when((F.coalesce(more, F.lit("")) != "") & ~more.rlike(NEXT_LABEL), F.concat_ws(" ", name, more)).otherwise(name)
        return F.when(section, full)

    return candidates(F.filter(F.transform(places(rows, r"(?iU)^Nome\s*/\s*Nome\s+empresarial\s*$"), of), lambda n: n.isNotNull()), NOT_OWN)


def _trade_name(text, rows, solid):
    """Unless the legal name is there."""
    got = candidates(F.slice(hits(text, NOTE_SHAPES["trade name"]), 1, 1), NOT_OWN, 3)
    return F.when(text.rlike(NOTE_SHAPES["legal name"]), F.array().cast(CANDIDATE)).otherwise(got)


def _no_digits(name: Column) -> Column:
    return stripped(F.regexp_replace(name, r"\d+", ""))


def _after_first_number(text, rows, solid):
    after = F.regexp_extract(text, rf"(?s){LOOSE_CNPJ}(.{{0,100}})", 1)
    name = ids.found(after, r"([A-ZÀÁÂÃÇÉÊÍÓÔÕÚ][A-Za-zÀ-ÿ\s&.\-]{5,80})", 1)
    refused = stripped(name).rlike(r"(?iU)^(?:Inscri[çc][ãa]o|Municipal|Estadual|CEP|AV\.|RUA|Telefone|Email)")
    return candidates(one(F.when(~refused, _no_digits(name))), NOT_OWN)


# Shapes of names in the layouts of service notes; a name has at most 200 characters.
NOTE_SHAPES = {
    "legal name": rf"(?iU)Nome/Raz[ãa]o\s+social\s*:\s*({WORDS}{{1,200}}{COMPANY_END})",
    "name and mail run together": r"(?iU)Nome/NomeEmpresarial\s+E-mail\s*\n\s*[\d.]+([A-ZÀ-ÿ][A-Za-zÀ-ÿ\s]+?)(?:\s+[A-Za-z0-9@._]+@|\s*$)",
    "name over mail": rf"(?iU)Nome\s*/\s*Nome\s+Empresarial\s*\n\s*E-?mail\s*\n\s*({WORDS}+?)(?:\s*\n|$)",
    "name beside mail": rf"(?iU)Nome\s*/\s*Nome\s+Empresarial\s+E-?mail\s*\n\s*({WORDS}+?)(?:\s+[a-zA-Z0-9_.+-]+@|\s*\n|$)",
    "issuer's section": rf"(?iU)(?:EMITENTE\s+DA\s+NFS-?e|Prestador\s+do\s+Servi[çc]o)\s*\n(?:[^\n]*\n){{0,5}}?Nome\s*/?\s*(?:Nome\s+)?Empresarial\s*\n?\s*E-?mail\s*\n\s*({WORDS}+?)(?:\s*\n|$)",
    "trade name": rf"(?iU)Nome\s+fantasia\s*:\s*({WORDS}{{3,50}}?)(?:\s*\n|$)",
    "company before number": rf"(?imU)({WORDS}{{1,200}}{COMPANY_END})\s*\n?\s*(?:CPF/)?CNPJ",
    "after verification code": rf"(?iU)(?:Código de Verificação|Verificação)\s+\w+\s+({WORDS}{{1,200}}{COMPANY_END})",
    "capitals before number": rf"(?isU)([A-ZÀ-ÿ][A-ZÀ-ÿ0-9\s&.\-]{{5,140}})\s+(?:CPF/)?CNPJ\s*[:\-]?\s*{LOOSE_CNPJ}",
    "label 1": r"(?imU)^\s*Raz[ãa]o\s+Social\s*[:\-]\s*([A-ZÀ-ÿ][A-Za-zÀ-ÿ\s&.\-]{5,100})\s*$",
    "label 2": r"(?iU)Raz[ãa]o\s+Social[^\n]*?[:\-\s]+([A-ZÀ-ÿ][A-Za-zÀ-ÿ\s&.\-]{5,100})",
    "label 3": r"(?iU)Prestador[^\n]*?:\s*([A-ZÀ-ÿ][A-Za-zÀ-ÿ\s&.\-]{5,120})",
    "label 4": r"(?iU)Nome[^\n]*?[:\-\s]+([A-ZÀ-ÿ][A-Za-zÀ-ÿ\s&.\-]{5,120})",
    "first company": rf"(?iU)\b([A-ZÀ-ÿ][A-Za-zÀ-ÿ0-9\s&.\-]{{5,80}}{COMPANY_END})\b",
}


def _no_mail(name: Column) -> Column:
    return F.regexp_replace(name, BEFORE_MAIL, "")


def _shape(name: str, *how) -> Rule:
    return Rule(name, _first_hit(NOTE_SHAPES[name], *how))


NOTE = (
    Rule("provider section", _provider_section),
    _shape("legal name", 5, "", lambda n: F.regexp_replace(stripped(n), rf"(?i)({COMPANY_END})\s+.*", "$1")),
    _shape("name and mail run together"),
    _shape("name over mail", 5, "", _no_mail),
    _shape("name beside mail"),
    _shape("issuer's section", 5, "", _no_mail),
    Rule("two lines", _two_lines),
    Rule("trade name", _trade_name),
    _shape("company before number", 5, "", lambda n: stripped(F.substring_index(stripped(n), "\n", -1))),
    _shape("after verification code"),
    _shape("capitals before number", 1, r"(?iU)^(?:TOMADOR|CPF|CNPJ|INSCRI|PREFEITURA|NOTA\s+FISCAL)\b", lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))),
    *(_shape(f"label {i}", 5, NO_NOTE_NAME, _no_digits) for i in range(1, 5)),
    _shape("first company", 1, r"(?iU)^(?:Documento|Regime|optante)", stripped),
    Rule("after first number", _after_first_number),
)


def note_supplier(text: Column, own: Column) -> Column:
    """(step, name) of a service note's provider; own: names of the user's companies, who are never it."""
    return first_passing(for_extraction(F.coalesce(text, F.lit(""))), NOTE, own)
