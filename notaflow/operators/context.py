"""What mail, readers and dimensions add to a document: subjects, bodies, candidate texts, companies, success codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, ids, money
from ..functions.fixed import ADMIN_NAMES, ADMIN_SUBJECTS, AUXILIARY, PAYMENT
from ..functions.text import matches_any, positive, present


def admin_subject(subject: Column) -> Column:
    """What kind of administrative mail a subject announces; null if it is none."""
    low = F.lower(subject)
    name = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in ADMIN_NAMES.items()], F.lit("Documento administrativo"))
    return F.when(matches_any(subject, ADMIN_SUBJECTS), name)


def auxiliary(text: Column, supplier: Column, amount: Column, file_name: Column) -> Column:
    """Statements always are; otherwise files named so that carry no amount."""
    begin = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(200)))
    states = begin.rlike("atestamos|declaramos") | F.coalesce(F.lower(supplier).rlike("^(atestamos|declaramos)"), F.lit(False))
    return F.when(states, True).when(positive(amount), False).otherwise(F.coalesce(F.lower(file_name).rlike("|".join(AUXILIARY)), F.lit(False)))


def looks_incomplete(text: Column) -> Column:
    """A text layer that lacks what its document must have, so that more should be read."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    days = F.regexp_count(t, F.lit(r"\b\d{2}\s*/\s*\d{2}\s*/\s*\d{4}\b"))
    sums = F.regexp_count(t, F.lit(r"\b\d{1,3}(?:\s*\.\s*\d{3})*\s*,\s*\d{2}\b"))
    marked = t.rlike(r"\b\d{2}\s*\.\s*\d{3}\s*\.\s*\d{3}\s*/\s*\d{4}\s*-\s*\d{2}\b") | t.rlike(r"\d{5}[.\s]\d{5}\s+\d{5}[.\s]\d{6}\s+\d{5}[.\s]\d{6}")
    return (F.length(t) < 200) | (marked & ((days < 1) | (sums < 1))) | ((F.length(t) < 600) & ((days < 2) | (sums < 1)))


def best_text(native: Column, tables: Column, scanned: Column, least: int = 50) -> Column:
    """The first reader's text that is long enough; the scan is added where the text layer looks incomplete."""
    def enough(c):
        return F.length(c) >= least
    more = F.when(enough(scanned), scanned)
    def with_scan(c):
        return F.when(looks_incomplete(c), F.concat_ws("\n", c, more)).otherwise(c)
    return F.coalesce(F.when(enough(native), with_scan(native)), F.when(enough(tables), with_scan(tables)), more)


def table_lines(header: Column, row: Column) -> Column:
    """'header: value' of each cell that is not empty."""
    pairs = F.transform(F.arrays_zip(header.alias("h"), row.alias("v")), lambda p: F.when(present(p["v"]), F.concat_ws(": ", p["h"], p["v"])))
    return F.array_compact(pairs)


def password_candidates(companies: DataFrame, cnpj: str) -> DataFrame:
    """Distinct candidates: whole number and its first 4, 5 and 8 digits."""
    d = ids.digits(F.col(cnpj))
    return companies.select(F.explode(F.array(d, F.left(d, F.lit(4)), F.left(d, F.lit(5)), F.left(d, F.lit(8)))).alias("candidate")).distinct()


def payment_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in PAYMENT.items() for x in kv])
    return F.when(present(code), F.coalesce(F.try_element_at(names, code), F.concat(F.lit("CODIGO_"), code)))


def missing_fields(supplier: Column, due: Column, number: Column, amount: Column) -> Column:
    """Required fields of a note that are absent."""
    def lacks(c):
        return ~F.coalesce(present(c), F.lit(False))
    return F.array_compact(F.array(F.when(lacks(supplier), F.lit("fornecedor_nome")), F.when(due.isNull(), F.lit("vencimento")), F.when(lacks(number), F.lit("numero_nota")), F.when(~positive(amount), F.lit("valor_total"))))


def failure_guess(file_name: Column, text: Column, number: Column, amount: Column) -> Column:
    return (
        F.when(F.lower(F.coalesce(file_name, F.lit(""))).rlike("boleto|recibo"), F.lit("BOLETO/RECIBO (Ignorar se não for NF)."))
        .when(F.lower(F.coalesce(text, F.lit(""))).rlike("locação|locacao"), F.lit("LOCAÇÃO (Layout atípico)."))
        .when(~positive(amount), F.lit("Regex de VALOR falhou."))
        .when(~F.coalesce(present(number), F.lit(False)) | (number == "VAZIO"), F.lit("Regex de NÚMERO DA NOTA falhou."))
        .otherwise(F.lit("Falha genérica de extração.")))


def body_fields(body: Column, today: Column) -> Column:
    """valor, confianca, vencimento, numero, link, codigo of a mail's body; the largest amount is the main one."""
    found = F.sort_array(F.array_distinct(F.filter(money.amounts(body), lambda v: v.between(0.01, 10_000_000))), False)
    value = F.get(found, F.lit(0))
    shown = money.render_br(value)
    after_total = F.contains(F.regexp_replace(F.lower(body), r"total[:\s]+r?\$?\s*", "total#"), F.concat(F.lit("total#"), shown))
    after_value = F.contains(F.regexp_replace(F.lower(body), r"valor[:\s]+r?\$?\s*", "valor#"), F.concat(F.lit("valor#"), shown))
    times = (F.length(body) - F.length(F.replace(body, shown, F.lit("")))) / F.length(shown)
    score = F.lit(0.5) + F.when(after_total, 0.3).when(after_value, 0.2).otherwise(0.0) + F.when(times > 1, 0.1).otherwise(0.0) - F.when(F.size(found) > 5, 0.2).otherwise(0.0)
    return F.struct(
        value.alias("valor"), F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(score, 2)))).alias("confianca"),
        dates.body_date(ids.found(body, r"(?iu)venc(?:imento|e)?[^\d\n]{0,20}(\d{1,2}/\d{1,2}(?:/\d{2,4})?)", 1), today).alias("vencimento"),
        ids.found(body, r"(?iu)(?:nota\s+fiscal|nf-?e?)\s*(?:n[ºo°.]*)?\s*[:#]?\s*(\d{2,})", 1).alias("numero"), ids.found(body, r"(https?://[^\s<>\"]+)", 1).alias("link"),
        ids.found(body, r"(?iu)c[oó]digo[^\n:=]{0,30}[:=]\s*([A-Za-z0-9-]{6,})", 1).alias("codigo"))


def sheet_number_of(link: Column) -> Column:
    """A note's number in the query of its link."""
    return ids.found(link, r"(?i)[?&](?:nf|nfe|numero|nota)=(\d+)", 1)


def company_of(docs: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """Per document, the own company whose number it names most often and first; null if it names none.

    companies: cnpj (14 digits), code. Numbers are exploded and looked up by an equi-join, never text by text.
    """
    named = docs.select(key, F.posexplode(F.transform(F.regexp_extract_all(text, F.lit(rf"({ids.CNPJ})"), F.lit(1)), ids.digits)).alias("at", "cnpj"))
    hit = named.join(companies.select("cnpj", "code"), "cnpj").groupBy(key, "code").agg(F.count("*").alias("times"), F.min("at").alias("first"))
    best = hit.groupBy(key).agg(F.max_by("code", F.struct("times", -F.col("first"))).alias("empresa"))
    return docs.select(key).join(best, key, "left")


def foreign_cnpj(docs: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """Per document, the first number that is no own company's."""
    named = docs.select(key, F.posexplode(F.transform(F.regexp_extract_all(text, F.lit(rf"({ids.CNPJ})"), F.lit(1)), ids.digits)).alias("at", "cnpj"))
    return named.join(companies.select("cnpj"), "cnpj", "left_anti").groupBy(key).agg(F.min_by("cnpj", "at").alias("cnpj"))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Insert or replace: of rows with one key the last wins."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order.desc()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def report_cases(report: DataFrame, text: str) -> DataFrame:
    """Cases of a text report: split at lines of dashes, with their fields and flags."""
    case = F.explode(F.split(text, "-{80}"))
    c = report.select(case.alias("case")).where(F.col("case").rlike(r"\S"))
    return c.select(ids.found(F.col("case"), r"(?m)^Batch:\s*(\S+)", 1).alias("batch"), ids.found(F.col("case"), r"(?m)^Valor:\s*(\S+)", 1).alias("valor"), F.contains("case", F.lit("SEM VENCIMENTO")).alias("no_due"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """metric lines of name, labels (map) and value."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.lit("{"), labels, F.lit("} "), F.col("value").cast("string")).alias("line"))


def content_scores(text: Column, kinds: dict[str, tuple[str, ...]]) -> tuple[dict[str, Column], Column]:
    """How many of each kind's words a text has, and how clear the winner is: the most over all."""
    low = F.lower(text)
    found = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in kinds.items()}
    most = F.greatest(*found.values()) if len(found) > 1 else next(iter(found.values()))
    return found, F.round(most / F.nullif(sum(found.values(), F.lit(0)), F.lit(0)), 4)
