"""Rows of the report layouts: the 18 columns of the ledger sheet, the two tabs, notices, and results of a run cut short.

Documents have the unified columns: doc_type (NFSE, DANFE, BOLETO, OUTRO, AVISO) and those named in the functions; dates are
dates. A column that a table lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .export import br_day

PAF = ("DATA", "SETOR", "EMPRESA", "FORNECEDOR", "NF", "EMISSAO", "VALOR", "N_PEDIDO", "VENCIMENTO", "FORMA_PAGTO", "INDICE", "DT_CLASS", "N_FAT", "TP_DOC", "TRAT_PAF", "LANC_SISTEMA", "OBSERVACOES", "OBS_INTERNA")
PARTIAL_NOTICE = ("tipo_documento", "arquivo_origem", "data_processamento", "email_date", "empresa", "fornecedor_nome", "numero_nota", "link_nfe", "codigo_verificacao", "dominio_portal", "email_subject", "vencimento", "observacoes", "status_conciliacao")
SIMPLE_NOTICE = ("email_id", "subject", "sender_name", "sender_address", "received_date", "link_nfe", "codigo_verificacao", "empresa")
NOTICE_FIRST = ("tipo_documento", "arquivo_origem", "data_processamento", "fornecedor_nome", "numero_nota", "link_nfe", "codigo_verificacao", "dominio_portal", "email_subject", "observacoes")


def with_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the columns it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def _text(*columns: str) -> Column:
    """The first of the columns that is not empty, or the empty text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


_DOC = {c: "string" for c in ("setor", "empresa", "fornecedor_nome", "numero_nota", "numero_documento", "numero_fatura", "numero_pedido", "referencia_nfse", "forma_pagamento", "tipo_doc_paf", "trat_paf", "lanc_sistema", "observacoes", "obs_interna", "link_nfe", "codigo_verificacao", "email_subject", "email_subject_full", "status_conciliacao", "situacao", "avisos")} | {c: "date" for c in ("data_processamento", "data_emissao", "vencimento", "dt_classificacao", "email_date")} | {c: "double" for c in ("valor_total", "valor_documento")}


def notice_observation() -> Column:
    link = F.nullif("link_nfe", F.lit(""))
    shown = F.when(F.length(link) <= 80, link).otherwise(F.concat(F.left(link, F.lit(77)), F.lit("...")))
    return F.concat_ws(" | ", F.lit("[SEM ANEXO]"), F.concat(F.lit("Link: "), shown), F.concat(F.lit("Código: "), F.nullif("codigo_verificacao", F.lit(""))), F.concat(F.lit("NF: "), F.nullif("numero_nota", F.lit(""))))


def paf_rows(docs: DataFrame, without_number: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ledger's 18 columns (after those in `keep`) for every document. without_number: invoice and bill numbers of
    notes and slips stay empty, as another system fills them in."""
    d = with_columns(docs, _DOC)
    note, slip, notice = F.col("doc_type").isin("NFSE", "DANFE"), F.col("doc_type") == "BOLETO", F.col("doc_type") == "AVISO"
    empty = F.lit("")
    hidden = F.lit(without_number)
    number = F.when(note, F.when(hidden, empty).otherwise(_text("numero_nota"))).when(slip, F.when(hidden, empty).otherwise(_text("referencia_nfse", "numero_documento"))).when(notice, _text("numero_nota")).otherwise(_text("numero_documento"))
    bill = F.when(hidden, empty).when(note, _text("numero_fatura")).when(slip, _text("referencia_nfse", "numero_documento")).otherwise(empty)
    value = F.when(notice, 0.0).when(slip, F.coalesce("valor_documento", F.lit(0.0))).otherwise(F.coalesce("valor_total", F.lit(0.0)))
    cells = (
        br_day(F.col("data_processamento")), _text("setor"), _text("empresa"), _text("fornecedor_nome"), number, F.when(notice, empty).otherwise(br_day(F.col("data_emissao"))), value,
        F.when(note | slip, _text("numero_pedido")).otherwise(empty), br_day(F.col("vencimento")), F.when(note | slip, _text("forma_pagamento")).otherwise(empty), empty, br_day(F.col("dt_classificacao")),
        bill, F.when(F.col("doc_type") == "DANFE", F.lit("NF")).otherwise(_text("tipo_doc_paf")), _text("trat_paf"), _text("lanc_sistema"),
        F.when(notice, F.coalesce(F.nullif("observacoes", empty), notice_observation())).otherwise(_text("observacoes")), _text("obs_interna"))
    return d.select(*keep, *[c.alias(n) for c, n in zip(cells, PAF, strict=True)])


def anexos_rows(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The tab of documents with attachments. situacao and avisos are what workdays.situation finds; a status that a
    document has already wins, and only then the found warnings are told too."""
    d = with_columns(docs, _DOC)
    slip, goods = F.col("doc_type") == "BOLETO", F.col("doc_type").isin("NFSE", "DANFE")
    final = F.coalesce(F.nullif("status_conciliacao", F.lit("")), F.nullif("situacao", F.lit("")))
    told = F.concat_ws(" | ", F.concat(F.lit("["), final, F.lit("]")), F.when(~final.eqNullSafe(F.col("situacao")), F.nullif("avisos", F.lit(""))), F.nullif("observacoes", F.lit("")))
    return d.select(*keep, br_day(F.col("data_processamento")).alias("PROCESSADO"), br_day(F.col("email_date")).alias("RECEBIDO"), _text("email_subject").alias("ASSUNTO"), F.lit("").alias("N_PEDIDO"), _text("empresa").alias("EMPRESA"),
                    br_day(F.col("vencimento")).alias("VENCIMENTO"), _text("fornecedor_nome").alias("FORNECEDOR"), F.when(goods, _text("numero_nota")).otherwise(_text("numero_documento")).alias("NF"),
                    F.when(slip, F.coalesce("valor_documento", F.lit(0.0))).otherwise(F.coalesce("valor_total", F.lit(0.0))).alias("VALOR"), F.coalesce(final, F.lit("")).alias("SITUACAO"), told.alias("AVISOS"))


def sem_anexos_rows(notices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The tab of mails without attachments."""
    d = with_columns(notices, _DOC)
    return d.select(*keep, br_day(F.col("data_processamento")).alias("PROCESSADO"), br_day(F.col("email_date")).alias("RECEBIDO"), _text("email_subject", "email_subject_full").alias("ASSUNTO"), F.lit("").alias("N_PEDIDO"),
                    _text("empresa").alias("EMPRESA"), _text("fornecedor_nome").alias("FORNECEDOR"), _text("numero_nota").alias("NF"), _text("link_nfe").alias("LINK"), _text("codigo_verificacao").alias("CODIGO"))


def simple_notices(notices: DataFrame) -> DataFrame:
    """What a person reads of notices: where to fetch what, all of it still to do."""
    return with_columns(notices, dict.fromkeys(SIMPLE_NOTICE, "string")).select(*SIMPLE_NOTICE, F.lit("PENDENTE_DOWNLOAD").alias("status"))


def partial_documents(batches: DataFrame) -> DataFrame:
    """Documents of stored batches (batch_id, email_subject, documents), a row each."""
    return batches.select("batch_id", F.coalesce("email_subject", F.lit("")).alias("email_subject"), F.explode("documents").alias("d")).select("d.*", "batch_id", "email_subject")


def partial_notices(notices: DataFrame) -> DataFrame:
    """Stored notices in the 14 columns that the sheet's loader reads."""
    d = with_columns(notices, dict.fromkeys(("email_id", "sender_name", "email_subject_full", "subject", *PARTIAL_NOTICE), "string"))
    made = {"tipo_documento": F.lit("AVISO"), "arquivo_origem": F.coalesce("email_id", F.lit("")), "fornecedor_nome": F.col("sender_name"), "email_subject": F.coalesce(F.nullif("email_subject_full", F.lit("")), "subject")}
    return d.select(*[made.get(c, F.col(c)).alias(c) for c in PARTIAL_NOTICE])
