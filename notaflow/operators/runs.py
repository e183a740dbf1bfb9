"""What runs and batches add up to: batch summaries, distributions, extractor use, sessions, validation, and reports in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import positive, present
from .batches import first_by_priority

NO_DUE = "[VENCIMENTO NÃO ENCONTRADO - verificar urgente]"
GENERIC_VALUE = "[VALOR EXTRAÍDO DE DOCUMENTO GENÉRICO - conferir manualmente]"
TRIED, ANSWERED, NONE_FITS = r"Testando extrator:\s+(\w+)", r"Resultado do can_handle de\s+(\w+):\s+(\w+)", r"Nenhum extrator compatível"


def batch_summary(docs: DataFrame, batches: DataFrame) -> DataFrame:
    """One row a batch with 16 columns. docs: batch_id, doc_seq, doc_type, fornecedor_nome, vencimento, numero_nota,
    numero_pedido, valor; batches: batch_id, source_folder, email_subject, email_sender, total_errors."""
    d = docs.withColumn("numero", F.when(F.col("doc_type").isin("NFSE", "DANFE", "BOLETO", "OUTRO"), F.nullif("numero_nota", F.lit(""))))
    has = F.coalesce(present(F.col("fornecedor_nome")), F.lit(False))
    name = first_by_priority(d, "fornecedor_nome", ("NFSE", "DANFE", "OUTRO", "BOLETO"), has, "fornecedor").select("batch_id", "fornecedor")
    due = first_by_priority(d, "vencimento", ("NFSE", "DANFE", "BOLETO", "OUTRO"), F.col("vencimento").isNotNull(), "venc").select("batch_id", F.col("venc").alias("vencimento"))
    value = first_by_priority(d, "valor", ("NFSE", "DANFE", "OUTRO", "BOLETO"), positive(F.col("valor")), "valor_compra").select("batch_id", F.coalesce("valor_compra", F.lit(0.0)).alias("valor_compra"))
    # A note's own number, then its order number, notes before goods; then other documents and slips.
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.nullif(c, F.lit("")).alias("n"), F.lit(k).alias("k")) for i, (k, c) in enumerate((("NFSE", "numero_nota"), ("DANFE", "numero_nota"), ("NFSE", "numero_pedido"), ("DANFE", "numero_pedido"), ("OUTRO", "numero_nota"), ("BOLETO", "numero_nota")))])
    at = d.select("batch_id", "doc_type", "doc_seq", F.explode(places).alias("p")).where("p.k = doc_type AND p.n IS NOT NULL")
    number = at.groupBy("batch_id").agg(F.min_by("p.n", F.struct("p.i", "doc_seq")).alias("numero_nota"))
    counts = d.groupBy("batch_id").agg(F.count("*").alias("total_documents"), *[F.count_if(F.col("doc_type") == k).alias(c) for k, c in (("DANFE", "danfes"), ("BOLETO", "boletos"), ("NFSE", "nfses"), ("OUTRO", "outros"), ("AVISO", "avisos"))],
                                       F.sum(F.when(F.col("doc_type") == "BOLETO", F.coalesce("valor", F.lit(0.0)).cast("decimal(20,4)")).otherwise(F.lit(0).cast("decimal(20,4)"))).cast("double").alias("valor_boleto"))
    out = batches.select("batch_id", "source_folder", "email_subject", "email_sender", "total_errors")
    for part in (name, due, number, counts, value):
        out = out.join(part, "batch_id", "left")
    return out.fillna(0, ["total_documents", "danfes", "boletos", "nfses", "outros", "avisos", "valor_boleto", "valor_compra"])


def has_multiple_invoices(docs: DataFrame) -> DataFrame:
    """batch_id, multiple: whether a batch has more than one note, or other document with an amount."""
    note = F.col("doc_type").isin("NFSE", "DANFE") | ((F.col("doc_type") == "OUTRO") & positive(F.col("valor")))
    return docs.groupBy("batch_id").agg((F.count_if(note) > 1).alias("multiple"))


def due_flag(docs: DataFrame) -> DataFrame:
    """docs with sem_vencimento: no document of the batch has a due date."""
    return docs.withColumn("sem_vencimento", F.max(F.col("vencimento").isNotNull()).over(W.partitionBy("batch_id")) == F.lit(False))


def divergence(base: Column, generic: Column, no_due: Column) -> Column:
    """Text of a batch's divergence with the warnings that hold; null without any."""
    return F.nullif(F.concat_ws(" ", F.nullif(base, F.lit("")), F.when(generic, F.lit(GENERIC_VALUE)), F.when(no_due, F.lit(NO_DUE))), F.lit(""))


def shares(df: DataFrame, key: str) -> DataFrame:
    """key, n, percent: how often each value occurs, the most frequent first."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # one row a value goes through it
    return n.select(key, "n", F.round(100.0 * F.col("n") / total, 2).alias("percent")).orderBy(F.desc("n"), key)


def extractor_events(records: DataFrame) -> DataFrame:
    """records (batch, message) with tried, answered, accepted and none_fits."""
    m = F.col("message")
    return records.withColumns({"tried": F.nullif(F.regexp_extract(m, TRIED, 1), F.lit("")), "answered": F.nullif(F.regexp_extract(m, ANSWERED, 1), F.lit("")), "accepted": F.lower(F.regexp_extract(m, ANSWERED, 2)) == "true", "none_fits": F.contains(m, F.lit(NONE_FITS))})


def extractor_usage(records: DataFrame) -> DataFrame:
    """extractor, used, succeeded, failed over log records."""
    e = extractor_events(records)
    told = e.select(F.coalesce("answered", "tried").alias("extractor"), F.col("tried").isNotNull().alias("t"), F.col("answered").isNotNull().alias("a"), "accepted").where("extractor IS NOT NULL")
    return told.groupBy("extractor").agg(F.count_if("t").alias("used"), F.count_if(F.col("a") & F.col("accepted")).alias("succeeded"), F.count_if(F.col("a") & ~F.col("accepted")).alias("failed"))


def extractors_of_batches(records: DataFrame, order: str) -> DataFrame:
    """batch, tried (distinct names), used (the last one that accepted), unmatched (times none fitted)."""
    e = extractor_events(records)
    return e.groupBy("batch").agg(F.sort_array(F.collect_set("tried")).alias("tried"), F.max_by(F.when(F.col("accepted"), F.col("answered")), F.when(F.col("accepted") & F.col("answered").isNotNull(), F.col(order))).alias("used"), F.count_if("none_fits").alias("unmatched"))


def slowest(df: DataFrame, key: str, duration: str, n: int = 5) -> DataFrame:
    return df.select(key, duration).orderBy(F.desc(duration), key).limit(n)


def validation_totals(docs: DataFrame, ok: str = "ok") -> DataFrame:
    """doc_type, succeeded, failed, success_rate in percent."""
    n = docs.groupBy("doc_type").agg(F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"))
    return n.withColumn("success_rate", F.round(100.0 * F.col("succeeded") / (F.col("succeeded") + F.col("failed")), 1))


def session_summary(counters: DataFrame) -> DataFrame:
    """One row: a session's counters (name, labels, value), each summed over its labels."""
    names = ("emails_scanned", "emails_processed", "emails_skipped", "emails_errors", "batches_created", "batches_processed", "documents_extracted", "avisos_created")
    return counters.agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names])


def run_summary(batches: DataFrame) -> DataFrame:
    """One row: documents, errors, amount and how many batches have each status."""
    states = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("OK", "TIMEOUT", "ERROR")]
    return batches.agg(F.count("*").alias("batches"), F.coalesce(F.sum("total_documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("total_errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.col("valor_compra").cast("decimal(20,4)")).cast("double"), F.lit(0.0)).alias("total"), *states)


def ingestion_totals(mails: DataFrame, documents: DataFrame, notices: DataFrame) -> DataFrame:
    """One row: mails scanned, with and without attachments, filtered out; documents and notices made of them.
    mails: has_attachment, decision."""
    none = F.lit(None)
    told = mails.select(F.lit("mail").alias("of"), "has_attachment", F.col("decision").alias("decision"))
    for of, df in (("document", documents), ("notice", notices)):
        told = told.unionByName(df.select(F.lit(of).alias("of"), none.cast("boolean").alias("has_attachment"), none.cast("string").alias("decision")))
    mail = F.col("of") == "mail"
    return told.agg(F.count_if(mail).alias("scanned"), F.count_if(mail & F.col("has_attachment")).alias("with_attachments"), F.count_if(mail & ~F.col("has_attachment")).alias("without_attachments"),
                    F.count_if(mail & (F.col("decision") != "PROCESS")).alias("filtered_out"), F.count_if(F.col("of") == "document").alias("documents"), F.count_if(F.col("of") == "notice").alias("notices"))


def filtered_cases(cases: DataFrame, severity: str | None = None, classification: str | None = None, issue: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Cases (id, severity, classification, issues) that meet every condition given."""
    out = cases
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if classification:
        out = out.where(F.col("classification") == classification.upper())
    if issue:
        out = out.where(F.exists("issues", lambda i: F.upper(i) == issue.upper()))
    if least is not None:
        out = out.where(F.col("id") >= least)
    return out if most is None else out.where(F.col("id") <= most)


def case_issues(subject: Column, supplier_faults: Column, due: Column, due_faults: Column, value: Column, number: Column, notes: Column, others: Column) -> Column:
    """struct of issue lists of an exported case: supplier, due, value, number, kind, dates."""
    up, missing = F.upper(F.coalesce(subject, F.lit(""))), F.trim(F.coalesce(due, F.lit(""))) == ""
    slip = up.rlike("BOLETO|FATURA")
    no_due = missing & (others > 0) & (notes == 0)
    told = F.when(no_due, F.when(slip | up.rlike("VENCIMENTO|VENCE"), F.lit("Vencimento não extraído (assunto sugere boleto/fatura)")).otherwise(F.lit("Vencimento não extraído (pode ser boleto)")))
    zero = F.array_contains(due_faults, F.lit("ZERADO"))
    documents = F.concat(F.lit("Valor zero com "), others.cast("string"), F.lit(" outros e "), notes.cast("string"), F.lit(" NFSEs"))

    def some(*issues: Column) -> Column:
        return F.array_compact(F.array(*issues))

    return F.struct(
        supplier_faults.alias("supplier"), F.concat(due_faults, some(told)).alias("due"), some(F.when((F.coalesce(value, F.lit(0.0)) == 0) & ((others > 0) | (notes > 0)), documents)).alias("value"),
        some(F.when((notes > 0) & (F.coalesce(number, F.lit("")) == ""), F.lit("Número da nota não extraído (para NFSE)"))).alias("number"),
        some(F.when(slip, F.lit("Assunto sugere boleto/fatura")).when(up.rlike("NF|NOTA"), F.lit("Assunto sugere nota fiscal"))).alias("kind"),
        some(F.when(zero, F.lit("Data zerada ou inválida")).when((F.size(due_faults) > 0) & ~missing, F.lit("Data de vencimento inválida")), F.when(no_due, F.lit("Data de vencimento faltante"))).alias("dates"))


def documents_of(xml: DataFrame, pdf: DataFrame, body: DataFrame) -> DataFrame:
    """All documents of batches: every XML one; of PDF ones slips and those whose number no XML one of the batch has; a
    body's only where no other document of its batch has a supplier or an amount. Columns: batch_id, doc_type,
    numero_nota, fornecedor_nome, valor."""
    number = F.trim("numero_nota")
    covered = xml.select("batch_id", number.alias("numero_nota")).where("numero_nota <> ''").distinct()
    slips, rest = pdf.where(F.col("doc_type") == "BOLETO"), pdf.where(F.coalesce(F.col("doc_type") != "BOLETO", F.lit(True)))
    named = rest.withColumn("numero_nota", number)
    left = slips.unionByName(named.join(covered, ["batch_id", "numero_nota"], "left_anti").select(*pdf.columns))
    docs = xml.unionByName(left, allowMissingColumns=True)
    valid = docs.where(F.coalesce(present(F.col("fornecedor_nome")), F.lit(False)) | positive(F.col("valor"))).select("batch_id").distinct()
    return docs.unionByName(body.join(valid, "batch_id", "left_anti"), allowMissingColumns=True)


def common_files(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def labelled(labels: Column, more: Column) -> Column:
    """Both maps; of a key in both the second one's value."""
    return F.map_concat(F.map_filter(labels, lambda k, _: ~F.map_contains_key(more, k)), more)


def unseen(files: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Files that the manifest of processed ones does not list."""
    return files.join(manifest.select(path).distinct(), path, "left_anti")


def _small(df: DataFrame, most: int):
    """All rows of a table of at most `most`; more are an error, as a report is one file's text."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a text report takes {most} rows at most; write the table instead")
    return rows


def as_text(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small report table as text: its title, a line, a line for each row."""
    return f"{title}\n{'-' * len(title)}\n" + _small(df, most).to_string(index=False) + "\n"


def as_markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    rows = _small(df, most)
    lines = [" | ".join(map(str, r)) for r in rows.itertuples(index=False)]
    return f"## {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n" + "".join(f"| {x} |\n" for x in lines)
