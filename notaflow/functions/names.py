"""Names of parties: what stands around and in a name on a document is taken off; '' for what is no name.

Four kinds of rule, each a few general ones: what is no name at all (a heading, a cell of a form); labels in front; tails
(tax numbers and their labels, addresses, mail, sites and handles, departments, delivery forms, codes, places); marks of
bad reading (brackets, letters made up, doubled glyphs, identifiers inside). Tails hang on each other, so they are taken off
until a fixed number of rounds is through. Then what is left must still be a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .phrases import bare, tree_pattern
from .text import let, strip_accents, unpair

#: Rounds of tails: a site behind a department behind a number is three.
ROUNDS = 4

_REGISTER = r"(?:CNPJ|CPF)(?:\s*(?:/|ou)\s*(?:CNPJ|CPF|MF))?"
#: Tails of a name, by kind. ALFA LTDA | CNPJ - CNPJ 1; BETA SA, inscrita no CNPJ sob o n. 2; GAMA LTDA CPF ou CNPJ
TAILS = {
    "tax number": rf"[\s,|=:/-]*(?:\binscrit[ao]\s+no\s+)?\b{_REGISTER}\b(?:\s+sob\b.*|\s*:\s*al\s.*|[\s.:|/-]*[\d./-]*\s*)",
    # DELTA SA - Endereço Rua X; ECO ME 3 ANDAR; ECO ME EDIF Z; - Município, CEP
    "address": r"\s+(?:-\s+)?(?:endere[çc]o|munic[íi]pio|cep\b|edif\b|\d+\s+andar\b|pc\s+presidente\b|centro\s+novo\b).*",
    # ALFA LTDA - CE - FORTALEZA; ALFA LTDA - Belo Horizonte/MG
    "place": r"\s+-\s+(?:[A-Z]{2}\s+-\s+\p{Lu}[\p{L}\s]+|\p{Lu}[\p{L}\s]+/\s*[A-Z]{2}\s*)",
    # ALFA SA fin@alfa.com; ALFA SA www.alfa.com; ALFA SA alfa.com.br
    "mail or site": r"\s+(?:\S*@\S*.*|www\.\S+|\S+\.(?:com|net|org)\.br\b.*)",
    # ALFA LTDA joaozinho, ALFA LTDA ana.souza: one small-letter word after capitals
    "handle": r"(?<=\p{Lu}{2})\s+(?-i:[a-z]{8,}|[a-z]+\.[a-z]+)",
    "department": r"\s+(?:contato|financeiro|comercial|ao\s+assinar|gerente\s+de\s+conta:.*)",
    "delivery form": r"\s*(?:/[\s\d-]*)?(?:\(\s*\)\s*)?\bmudou-se\b.*",
    # BETA LTDA F50C0E532 Inscrição Municipal 1; GAMA SA Cod. de Autenticidade 2
    "register": r"\s+(?:[A-F0-9]{6,}\s+)?inscri[çc][ãa]o\s+municipal\b.*|\s+cod\.?\s+de\s+autenticidade\b.*",
    "form label": r"\s+nome\s+(?:/\s*nome\s+)?(?:empresarial|fantasia)\b.*|\s+\|?\s*cnl\.",
    "abroad": r"\s+(?:florida[\s\d]*usa|taxid)\b?.*",
    # ALFA LTDA 393, ALFA LTDA 12/3, ALFA LTDA ****/****
    "number or stars": r"[\s/|-]+(?:\d[\d./-]*|\*[*/]+)",
}
#: Labels in front of a name.
FRONT = rf"(?iU)^(?:(?:e-mail|benefici[aá]rio|nome\s*(?:/\s*nome)?\s*empresarial|raz[aã]o\s+social)\s*:?\s+|{_REGISTER}[:\s]+)+"
# Headings and cells of forms, without accents: the whole text, or how it begins.
HEADINGS = (
    "DOCUMENTO(S)", "DOCUMENTOS", "DOCUMENTO", "BENEFICIARIO", "CEDENTE", "SACADO", "PAGADOR", "RECEBEDOR", "NOME DO RECEBEDOR", "EMITENTE DA NFS-E", "EMITENTE DA NFSE", "PRESTADOR DE SERVICOS", "PRESTADOR DO SERVICO",
    "TOMADOR DO SERVICO", "TOMADOR DE SERVICOS", "RAZAO SOCIAL", "NOME EMPRESARIAL", "NOME FANTASIA", "CNPJ", "CPF", "CEP", "CNPJ/CPF", "CPF/CNPJ", "VENCIMENTO", "VALOR", "CARTEIRA", "ESPECIE", "ACEITE", "AGENCIA", "CONTA", "VALOR DA CAUSA", "UTILIDADE", "SISTEMAS LTDA",
)
BEGINNINGS = (
    "CEDENTE NUMERO DO DOCUMENTO", "NUMERO DO DOCUMENTO ESPECIE", "ESPECIE QUANTIDADE", "VALOR DO DOCUMENTO", "EMITENTE DA NFS-E PRESTADOR", "PRESTADOR DE SERVICO NOME", "NOME EMPRESARIAL", "NOME / NOME EMPRESARIAL", "NOME/NOME EMPRESARIAL", "( ) ", "()",
    "NO INTERNET BANKING", "PARA PAGAMENTO:", "FAVORECIDO:", "CONTAS A RECEBER", "CONTAS A PAGAR", "CEP:", "CEP ", "CENTRO NOVO ", "PC PRESIDENTE ", "PRACA PRESIDENTE ", "FLORIDA",
)
STATES = ("MG", "SP", "RJ", "PR", "SC", "RS", "BA", "GO", "DF", "ES", "PE", "CE", "PA", "MA", "MT", "MS", "USA", "BR")
NUMBERS = r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b|\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d+[./]\d+\b|\b\d{4,}\b|[Êê□▢■▭▯�]"


def no_name(text: Column) -> Column:
    """Whether a text is a heading, a cell of a form, a site or a code with a label."""
    plain = F.upper(strip_accents(F.regexp_replace(text, r"\s+", " ")))
    form = rf"^(?:{tree_pattern(HEADINGS)})[\s:]*\d*$|^(?:{tree_pattern(BEGINNINGS)})|^\S+\.[A-Z]{{2,3}}\.BR\b|^(?:[A-Z0-9-]{{4,12}}\s+[\dU]{{5,}}\s+)?PRESTADOR DE SERVICOS?\s+[A-Z0-9-]+\s+\d"
    return let(plain, lambda p: p.rlike(form) | p.rlike(r"^[A-Z0-9-]{6,17}\s+\d+U?\d*\s+PRESTADOR"))


def _trimmed(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ \-:;/]+|[ \-:;/]+$", "")


def _without_tails(name: Column, rounds: int = ROUNDS) -> Column:
    """Tails taken off until a round finds none; no tail begins elsewhere than the look-ahead says, which passes most letters by."""
    tail = r"(?iU)(?=[\s,|=:/(\-]|\b[cim])(?:" + "|".join(f"(?:{t})" for t in TAILS.values()) + r")\s*$"

    def more(before: Column, after: Column) -> Column:
        return F.when(after == before, after).otherwise(_without_tails(after, rounds - 1))

    return F.regexp_replace(name, tail, "") if rounds == 1 else let(name, lambda n: let(F.regexp_replace(n, tail, ""), lambda m: more(n, m)))


def _well_read(name: Column) -> Column:
    """No brackets, letters that a reader made up at the end, doubled glyphs, labels run into the name."""
    name = F.regexp_replace(F.regexp_replace(name, r"\s*\[[^\]]*(?:\]|$)", " "), r"\s+(?:[A-Za-z]([a-z])\1{2,}|([a-z])\2([a-z])\3)\s*$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\.{2,}", " "), r"(?iu)^benefici[aá]rio\s*", "")
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " "), unpair), " ")


def entity_name(raw: Column, split: Callable[[Column], Column] | None = None) -> Column:
    """A party's name, or ''. split takes words that were run together apart."""
    def cleaned(text: Column) -> Column:
        name = _without_tails(F.regexp_replace(text, FRONT, ""))
        name = F.regexp_replace(name, r"(?iu)\s+nota\s+de\s+d[ée]bito\s+", " ")
        return F.when(no_name(text), F.lit("")).otherwise(F.when(no_name(name), F.lit("")).otherwise(split(name) if split else name))

    def checked(name: Column) -> Column:
        last = F.regexp_replace(_trimmed(name), r"^(\S+ \S.*?) [A-Za-z]([a-z])\2{1,2}$", "$1")
        return let(F.trim(_without_tails(last, 2)), lambda n: F.when((F.length(n) < 3) | F.upper(n).isin(*STATES, "CNPJ", "CPF", "CEP") | n.rlike(r"(?i)^(?:Florida|California|Texas|New York)\s+(?:USA|US)?\s*$"), F.lit("")).otherwise(n))

    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    return let(let(text, cleaned), lambda n: let(F.regexp_replace(_well_read(n), NUMBERS, " "), lambda m: checked(_without_tails(m, 2))))


# ---- names run together

#: Moves a character out of the words' reach and back.
_SHIFT = 0xE000


def split_name(name: Column, words: tuple[str, ...] = fixed.NAME_WORDS, least: int = 15) -> Column:
    """A name of `least` characters and more without a blank, taken apart at known words, forms of company last. The longest word is
    looked for first over the whole name, and what it takes no other word can have; a name without any is left as it is."""
    known = sorted({w for v in words if len(v) > 2 for w in (v, bare(v))}, key=lambda w: (-len(w), w))
    letters = "".join(sorted({c for w in known for c in w}))
    hidden = "".join(chr(_SHIFT + i) for i in range(len(letters)))
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(" " + w.translate(str.maketrans(letters, hidden)) + " ").alias("hidden")) for w in known])
    parted = F.aggregate(table, F.upper(name), lambda acc, w: F.replace(acc, w["word"], w["hidden"]))
    parted = F.trim(F.regexp_replace(F.translate(parted, hidden, letters), " +", " "))
    parted = F.regexp_replace(parted, r"(?<=[^ ])(LTDA|EIRELI|S\.A\.?|S/A|EPP)$", " $1")
    return F.when((F.length(name) >= least) & ~name.rlike(r"\s"), let(parted, lambda p: F.when(F.contains(p, F.lit(" ")), p).otherwise(name))).otherwise(name)
