"""Field extraction in five shapes, each a builder of Columns; documents' fields are rule data fed to them.

first_match: ordered patterns, the first hit whose value counts. largest_of: the largest amount. scored: candidates with
points for words around them, best first. outside: the first hit with no forbidden word around it. keyed: keyword to
constant. below_label: the first value in the lines under a label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids, money
from ..functions.text import label_then_lines, let, occurrences
from . import cascades

AMOUNT = r"(\d{1,3}(?:\.\d{3})*,\d{2})"
DAY = r"(\d{2}/\d{2}/\d{2,4})"


def first_match(text: Column, patterns: tuple[str, ...], parse=None, counts=None) -> Column:
    """parse turns the hit into a value, counts says which values count (all that are not null by default). No pattern is looked
    for after the one whose value counts."""
    def value(hit: Column) -> Column:
        return F.when(hit.isNotNull(), parse(hit))

    def of(p: str) -> Column:
        got = let(ids.found(text, p, 1), value) if parse else ids.found(text, p, 1)
        return let(got, lambda v: F.when(counts(v), v)) if counts else got

    return F.coalesce(*map(of, patterns))


def amount_of(hit: Column) -> Column:
    return F.when(hit.isNotNull(), money.parse_br(hit))


def first_amount(text: Column, patterns: tuple[str, ...], low: float = 0.0, high: float = 1e12) -> Column:
    return first_match(text, patterns, amount_of, lambda v: (v > low) & (v < high))


def first_day(text: Column, patterns: tuple[str, ...]) -> Column:
    return first_match(text, patterns, dates.parse_br)


def largest_of(text: Column, low: float = 0.0, high: float = 1e12) -> Column:
    return F.array_max(F.filter(money.amounts(text), lambda v: (v > low) & (v < high)))


def hits_with_context(text: Column, pattern: str, before: int, after: int) -> Column:
    """All hits with the text around each, up to `before` and `after` characters, whatever other hits are in it: array of (value, context)."""
    def around(o: Column) -> Column:
        begin = F.greatest(o["start"] - before, F.lit(0))
        context = F.concat(F.substring(text, begin + 1, o["start"] - begin), F.lit(" "), F.substring(text, o["end"] + 1, F.lit(after)))
        return F.struct(F.regexp_extract(o["raw"], pattern, 1).alias("value"), context.alias("context"))

    return F.transform(occurrences(text, pattern), around)


def scored(text: Column, pattern: str, points: dict[str, int], parse, before: int = 60, after: int = 20, least: int = 1) -> Column:
    """The candidate with most points, of equals the largest value; null if none has `least`."""
    def score(h):
        return sum((F.when(h["context"].rlike("(?iu)" + w), p).otherwise(0) for w, p in points.items()), F.lit(0))

    rated = F.transform(hits_with_context(text, pattern, before, after), lambda h: F.struct(score(h).alias("score"), parse(h["value"]).alias("value")))
    return F.array_max(F.filter(rated, lambda r: (r["score"] >= least) & r["value"].isNotNull()))["value"]


@dataclass(frozen=True)
class Weights:
    """How an amount's line speaks for it. contexts: words that give `at`; words: (word, weight, word that forbids it);
    item: weight of amounts over 100 on lines that begin like an item; more: whether large amounts get one to three more."""

    contexts: tuple[str, ...]
    at: int
    words: tuple[tuple[str, int, str], ...] = ()
    item: int = 0
    more: bool = True
    pattern: str = r"R?\$?\s*(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"


def weighted_amount(text: Column, w: Weights) -> Column:
    """The amount whose line speaks most for it, of equals the largest; null without any."""
    def rated(line: Column) -> Column:
        up = F.upper(line)
        weight = F.when(reduce(lambda a, b: a | b, [F.contains(up, F.lit(c)) for c in w.contexts]), w.at).otherwise(1)
        for word, points, unless in w.words:
            ok = F.contains(up, F.lit(word))
            weight = F.greatest(weight, F.when(ok & ~F.contains(up, F.lit(unless)) if unless else ok, points).otherwise(1))

        def one(cell: Column) -> Column:
            value = F.replace(F.replace(cell, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("double")
            points = weight
            if w.item:
                points = F.greatest(points, F.when(line.rlike(r"^\s*\d+\s+[^\d]*\d+[.,]\d+") & (value > 100), w.item).otherwise(1))
            if w.more:
                points = points + F.when(value > 1000, 3).when(value > 100, 2).when(value > 10, 1).otherwise(0)
            return F.struct(points.alias("points"), value.alias("value"))

        return F.transform(F.regexp_extract_all(line, F.lit(w.pattern), F.lit(1)), one)

    every = F.flatten(F.transform(F.split(text, "\n"), rated))
    return F.array_max(F.filter(every, lambda r: r["value"] >= 0.01))["value"]


def outside(text: Column, pattern: str, forbidden: str, parse, before: int = 80, after: int = 30) -> Column:
    good = F.filter(hits_with_context(text, pattern, before, after), lambda h: ~h["context"].rlike("(?iu)" + forbidden))
    return parse(F.get(good, F.lit(0))["value"])


def keyed(text: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.rlike("(?iu)" + k), F.lit(v)) for k, v in names.items()])


def below_label(text: Column, label: str, pattern: str, parse, lines: int = 3) -> Column:
    under = label_then_lines(F.split(text, "\n"), "(?iu)" + label, lines)
    values = F.transform(under, lambda x: parse(ids.found(x, pattern, 1)))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def smallest_day(text: Column) -> Column:
    return F.array_min(F.transform(F.regexp_extract_all(text, F.lit(DAY), F.lit(1)), dates.parse_br))


def latest_day(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(DAY), F.lit(1)), dates.parse_br))


def instalments(text: Column) -> Column:
    """All 'n/m date amount' of a text; the first of them is first by the text of n/m."""
    pattern = r"(\d{1,3}/\d{1,3})\s+" + DAY + r"\s+(?:R\$\s*)?" + AMOUNT
    part, day, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    return F.transform(part, lambda p, i: F.struct(p.alias("parcela"), dates.parse_br(F.get(day, i)).alias("vencimento"), money.parse_br(F.get(value, i)).alias("valor")))


# ---- slips

def slip_columns(t: Column) -> dict[str, Column]:
    """Amount: labelled, then the digit line's cents, then near a label, then the largest. Due: by context, else under its
    label, else the digit line's factor, else the latest."""
    line = ids.slip_line(t)
    labelled = first_amount(t, (r"(?iu)valor\s+do\s+documento\s*:?\s*(?:R\$)?\s*" + AMOUNT, r"(?iu)valor\s+cobrado\s*:?\s*(?:R\$)?\s*" + AMOUNT))
    near = below_label(t, r"valor\s+(do\s+documento|cobrado|nominal)", AMOUNT, amount_of)
    cents = F.when(money.of_slip_line(line) > 0, money.of_slip_line(line))
    due = F.coalesce(first_day(t, (r"(?iu)vencimento\s*:?\s*" + DAY, r"(?iu)vence\s+em\s*:?\s*" + DAY)), below_label(t, "vencimento", DAY, dates.parse_br),
                     scored(t, DAY, {"venc": 3, "pag": 1, "emiss|process": -3}, dates.parse_br), dates.due_from_factor(dates.factor_of_line(line)), latest_day(t))
    return {
        "linha_digitavel": line, "valor": F.coalesce(labelled, cents, near, largest_of(t), F.lit(0.0)), "vencimento": due,
        "numero": first_match(t, (r"(?iu)n[uú]mero\s+do\s+documento\s*:?\s*([\w./-]+)", r"(?iu)nosso\s+n[uú]mero\s*:?\s*([\d/-]+)", r"(?iu)\bdoc(?:umento)?\s*n[ºo°]?\s*:?\s*(\d[\w./-]*)")),
        "cnpj": F.coalesce(ids.cnpj(t), ids.flexible_cnpj(t)), "fornecedor_nome": cascades.slip_supplier(t)["name"],
        "data_emissao": F.coalesce(first_day(t, (r"(?iu)data\s+(?:do\s+documento|de\s+emiss[aã]o|do\s+processamento)\s*:?\s*" + DAY,)), smallest_day(t))}


def slip_fields(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(slip_columns(F.col(text)))


# ---- service notes, goods notes, other documents

TAX = r"(?:reten|desconto|dedu|iss|inss|irrf|pis|cofins|csll|al[ií]quota)"


def note_columns(t: Column) -> dict[str, Column]:
    labels = tuple(r"(?iu)" + w + r"\s*:?\s*(?:\(?R\$\)?)?\s*" + AMOUNT for w in (r"valor\s+total\s+da\s+nota", r"valor\s+l[ií]quido(?:\s+da\s+nota)?", r"valor\s+(?:total\s+)?dos\s+servi[cç]os", r"valor\s+total", r"total\s+a\s+pagar", r"total\s+geral", r"total"))
    def tax(name):
        return F.coalesce(first_amount(t, (rf"(?iu)\b{name}\b[^\d\n]{{0,20}}" + AMOUNT,)), F.lit(0.0))
    return {
        "valor": F.coalesce(first_amount(t, labels), outside(t, AMOUNT, TAX, amount_of), largest_of(t), F.lit(0.0)),
        "numero": first_match(t, (r"(?iu)n[uú]mero\s+da\s+n(?:ota|fs-?e)\s*:?\s*(\d+)", r"(?iu)nota\s+fiscal[^\d\n]{0,30}(\d{1,15})", r"(?iu)nfs?-?e\s*n?[ºo°.]*\s*:?\s*(\d+)", r"(?iu)fatura\s*n?[ºo°.]*\s*:?\s*(\d+)"), lambda c: F.nullif(F.regexp_replace(c, "^0+", ""), F.lit(""))),
        "vencimento": F.coalesce(first_day(t, (r"(?iu)vencimento\s*:?\s*" + DAY, r"(?iu)vence\s+em\s*:?\s*" + DAY)), below_label(t, "vencimento", DAY, dates.parse_br)),
        "data_emissao": F.coalesce(first_day(t, (r"(?iu)emiss[aã]o\s*:?\s*" + DAY, r"(?iu)emitid[ao]\s+em\s*:?\s*" + DAY, r"(?iu)compet[eê]ncia\s*:?\s*" + DAY)), dates.first_br(t)),
        "cnpj": F.coalesce(ids.cnpj(t), ids.flexible_cnpj(t)), "chave_acesso": ids.access_key(t),
        "fornecedor_nome": F.coalesce(first_match(t, (r"(?iu)raz[aã]o\s+social\s*/?\s*(?:nome)?\s*:?\s*([^\n]+)", r"(?iu)prestador(?:\s+de\s+servi[cç]os)?\s*:?\s*([^\n]+)", r"(?iu)recebemos\s+de\s+(.+?)\s+os\s+produtos", r"(?m)^([^\n]+?(?:LTDA|S/A|S\.A\.|EIRELI|ME))\s")), keyed(t, {r"\btim\b": "TIM S.A.", "cemig": "CEMIG", "copasa": "COPASA", "sabesp": "SABESP", "locaweb": "LOCAWEB"})),
        "valor_iss": tax("ISS(?:QN)?"), "valor_ir": tax("IRR?F?"), "valor_inss": tax("INSS"), "valor_csll": tax("CSLL"), "numero_pedido": ids.order_number(t)}


def note_fields(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(note_columns(F.col(text)))


def extracted(routed: DataFrame, text: str = "text", own: Column | None = None) -> DataFrame:
    """Fields of every routed document in one pass, so that it is routed once: slips by their rules, all others by theirs;
    service notes take their provider from the cascade first. own: names of the user's companies."""
    t, kind = F.col(text), F.col("doc_type")
    slip, note = slip_columns(t), note_columns(t)
    own = F.array().cast("array<string>") if own is None else own
    note["fornecedor_nome"] = F.coalesce(F.when(kind == "NFSE", cascades.note_supplier(t, own)["name"]), note["fornecedor_nome"])
    nothing = F.lit(None)
    return routed.withColumns({c: F.when(kind == "BOLETO", slip.get(c, nothing)).otherwise(note.get(c, nothing)) for c in {**slip, **note}})
