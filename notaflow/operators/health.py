"""Health of exported batches: what kind each is, what is wrong with it, and how bad that is.

batches: fornecedor, email_subject, vencimento (text), valor_compra, nfses, boletos, outros, pdf_protegido.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import PAID_FILES, PAID_SUBTYPES
from ..functions.text import present
from .quality import exploded, problem

# Names of own companies, texts that are no supplier, short names that are real ones, and subject words.
INTERNAL = ("CARRIER", "RBC", "CSC", "MOC", "EXATA", "ATIVE", "ORION", "ITACOLOMI", "FLORESTA", "SUNRISE")
UNTREATED = ("identificada a seguir", "prestador de serviços nome", "documento do beneficiário", "chave de acesso:")
NOT_A_NAME = ("identificada a seguir", "prestador de serviços nome", "documento do beneficiário", "cnpj", "fornecedor", "chave de acesso", "seus dados")
SHORT_NAMES = ("GOX", "CEMIG", "COPASA", "EDP", "TIM", "VIVO", "CLARO", "OI", "SABESP")
PERSONS = ("marco", "túlio", "lima", "natalia", "ferreira", "silva", "raphaela")
COMMISSION = ("comissão", "comissões", "comissao", "comissoes")
SUGGESTS_SLIP = ("BOLETO", "FATURA", "VENCIMENTO", "PAGAMENTO")
CLOSING = ("encerramento", "desligamento", "cancelamento", "rescisão")
PAID = ("COMPROVANTE", "TED", "TRANSFERENCIA", "TRANSFERÊNCIA", "PAGAMENTO REALIZADO", "PAGAMENTO EFETUADO", "SOLICITACAO DE PAGAMENTO", "SOLICITAÇÃO DE PAGAMENTO", "INFORMAÇÃO PAGAMENTO", "INFORMACAO PAGAMENTO", "COMP PGTO")
RENTAL = ("EMPREENDIMENTOS", "LOCAÇÃO", "LOCACAO", "ALUGUEL", "IMOBILIARIA", "IMOBILIÁRIA")
POWER = ("EDP", "CEMIG", "NEOENERGIA", "ELEKTRO", "CPFL", "ENERGISA", "ENEL", "LIGHT")
WATER = ("COPASA", "SABESP", "SANEPAR")
#: First words of a subject decide.
SUBJECT_TYPES = (("DANFE_COMO_ADMIN", ("NOTA FISCAL FAT/", "DANFE")), ("TCF_TELECOM_PROBLEM", ("TCF TELECOM",)), ("BOX_BRAZIL_PROBLEM", ("BOX BRAZIL",)), ("NOTIFICACAO_AUTOMATICA", ("NOTIFICAÇÃO AUTOMÁTICA",)), ("RELATORIO_ADMIN", ("RELATÓRIO",)), ("CEMIG_FATURA", ("CEMIG",)), ("FATURAMENTO_ADMIN", ("FATURAMENTO",)))


def _in(c: Column, words) -> Column:
    return F.coalesce(c.rlike("|".join(w.replace("/", r"\/").replace(".", r"\.") for w in words)), F.lit(False))


def kind(supplier: Column, subject: Column, notes: Column, slips: Column, others: Column, files: Column | None = None, subtypes: Column | None = None) -> Column:
    """Main kind of a batch. files and subtypes: names of its files and subtypes of its documents, as arrays."""
    who, what = F.upper(F.coalesce(supplier, F.lit(""))), F.upper(F.coalesce(subject, F.lit("")))
    words = F.filter(F.split(who, r"\s+"), lambda w: w != "")
    company = _in(who, ("LTDA", "S.A.", "S/A", "EIRELI", "MEI"))
    person = (F.size(words) >= 3) & ~company & F.forall(words, lambda w: w.rlike(r"^\p{L}+$"))
    paid = _in(what, PAID) | (person & _in(what, ("CONSUMO", "PAGAMENTO", "PGTO")))
    if files is not None:
        paid = paid | F.coalesce(F.exists(files, lambda f: _in(F.upper(f), PAID_FILES)), F.lit(False))
    if subtypes is not None:
        paid = paid | F.coalesce(F.exists(subtypes, lambda s: F.upper(s).isin(*PAID_SUBTYPES)), F.lit(False))
    by_subject = company | (F.size(words) > 3)  # a person's bill isn't told by its subject
    other = (
        F.when(paid, F.lit("COMPROVANTE_PAGAMENTO")).when(_in(who, RENTAL), F.lit("OUTRO")).when(_in(who, POWER), F.lit("UTILITY_ENERGY")).when(_in(who, WATER), F.lit("UTILITY_WATER"))
        .when(by_subject & _in(what, ("ENERGIA", "LUZ", "ELETRIC")), F.lit("UTILITY_ENERGY")).when(by_subject & _in(what, ("AGUA", "ÁGUA", "SANEAMENTO")), F.lit("UTILITY_WATER")).otherwise(F.lit("OUTRO")))
    return F.when(notes > 0, F.lit("NFSE")).when(slips > 0, F.lit("BOLETO")).when(others > 0, other).otherwise(F.lit("EMAIL_BODY"))


def valid_supplier(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 3) & ~(F.contains(n, F.lit("@")) & F.contains(n, F.lit(".com"))) & ~_in(F.lower(n), NOT_A_NAME)


def is_internal(name: Column) -> Column:
    return F.coalesce(F.trim(F.upper(name)).isin(*INTERNAL), F.lit(False))


def problems(batches: DataFrame) -> DataFrame:
    """A row for each problem: batch columns, kind, severity."""
    name, subject = F.coalesce("fornecedor", F.lit("")), F.coalesce("email_subject", F.lit(""))
    value, main = F.coalesce("valor_compra", F.lit(0.0)), F.col("main_kind")
    has_value, person, commission = value > 0, _in(F.lower(name), PERSONS), _in(F.lower(subject), COMMISSION)
    no_due = has_value & ~F.coalesce(present(F.col("vencimento")), F.lit(False))
    slip, up = _in(F.upper(subject), SUGGESTS_SLIP), F.upper(subject)
    utility, other = main.isin("UTILITY_ENERGY", "UTILITY_WATER"), main == "OUTRO"
    telecom = _in(F.upper(name), ("AMERICAN TOWER", "TOWER DO BRASIL")) | _in(up, ("NFCOM", "FATURAMENTO"))
    small_rent = (value < 50) & _in(F.upper(name), ("EMPREENDIMENTOS", "LOCAÇÃO", "LOCACAO"))
    in_slip = (F.col("boletos") > 0) | (_in(up, ("NOTA", "NF")) & _in(up, ("BOLETO",)))
    closing = _in(F.lower(subject), CLOSING)
    rules = [
        (is_internal(F.col("fornecedor")), "FORNECEDOR_INTERNO", "CRITICA"), (has_value & (F.trim(name) == ""), "FORNECEDOR_VAZIO", "CRITICA"),
        (has_value & F.contains(name, F.lit("@")) & F.contains(name, F.lit(".com")), "FORNECEDOR_EMAIL", "ALTA"), (_in(F.lower(name), UNTREATED), "FORNECEDOR_TEXTO_PDF", "ALTA"),
        (has_value & (F.length(F.trim(name)) < 10) & (value > 1000) & ~_in(F.upper(name), SHORT_NAMES), "FORNECEDOR_CURTO", "ALTA"),
        ((value > 10000) & person & ~commission, "FORNECEDOR_PESSOA_VALOR_ALTO", "ALTA"), ((value > 10000) & person & commission, "MEI_COMISSAO_OK", "INFO"),
        (no_due & (main == "NFSE") & slip, "NFSE_SEM_VENCIMENTO", "INFO"),
        (no_due & utility & closing, "UTILITY_ENCERRAMENTO", "INFO"), (no_due & utility & ~closing & (value < 1), "UTILITY_VALOR_ACUMULADO", "INFO"), (no_due & utility & ~closing & (value >= 1), "UTILITY_SEM_VENCIMENTO", "MEDIA"),
        (no_due & (main == "EMAIL_BODY") & F.col("pdf_protegido"), "PDF_PROTEGIDO_SEM_VENCIMENTO", "INFO"), (no_due & (main == "EMAIL_BODY") & ~F.col("pdf_protegido") & slip, "EMAIL_BODY_SEM_VENCIMENTO", "BAIXA"),
        (no_due & (main == "COMPROVANTE_PAGAMENTO"), "COMPROVANTE_OK", "INFO"),
        (no_due & other & telecom, "NFCOM_SEM_VENCIMENTO", "INFO"), (no_due & other & ~telecom & small_rent, "FATURA_LOCACAO_BAIXO_VALOR", "INFO"), (no_due & other & ~telecom & ~small_rent & in_slip, "VENCIMENTO_NO_BOLETO", "INFO"),
        (no_due & slip & ((other & ~telecom & ~small_rent & ~in_slip) | (main == "BOLETO")), "VENCIMENTO_AUSENTE", "MEDIA"),
    ]
    b = batches.withColumn("main_kind", kind(F.col("fornecedor"), F.col("email_subject"), F.col("nfses"), F.col("boletos"), F.col("outros")))
    return exploded(b, [problem(F.coalesce(c, F.lit(False)), k, level) for c, k, level in rules])


def problem_type(subject: Column, divergence: Column) -> Column:
    up, div = F.upper(F.coalesce(subject, F.lit(""))), F.upper(F.coalesce(divergence, F.lit("")))
    first = F.when(_in(up, ("LEMBRETE GENTIL",)) & _in(div, ("NOTA FISCAL",)), F.lit("NFSE_MAL_CLASSIFICADA"))
    return F.coalesce(first, *[F.when(_in(up, words), F.lit(name)) for name, words in SUBJECT_TYPES], F.lit("OUTROS"))


def zero_value_cases(batches: DataFrame) -> DataFrame:
    return batches.where("(outros > 0 OR nfses > 0) AND coalesce(valor_compra, 0) = 0")


def pair_counts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of each kind in each pair; a batch's only pair counts all documents of the batch.

    pairs: batch_id, pair_id, note_docs, slip_docs. docs: batch_id, doc_type, arquivo_origem. Joined by file, not by nested lists.
    """
    from pyspark.sql import Window as W

    kinds = ("DANFE", "NFSE", "OUTRO")
    def counts(name):
        return [F.count_if(F.col("doc_type") == k).alias(f"{name}{k.lower()}") for k in (*kinds, "BOLETO")]
    own = pairs.select("batch_id", "pair_id", F.explode("note_docs").alias("arquivo_origem")).join(docs, ["batch_id", "arquivo_origem"]).groupBy("pair_id").agg(*counts("p_"))
    every = docs.groupBy("batch_id").agg(*counts("b_"))
    p = pairs.withColumn("n", F.count("*").over(W.partitionBy("batch_id"))).join(own, "pair_id", "left").join(every, "batch_id", "left")
    return p.select("batch_id", "pair_id", *[F.coalesce(F.when(F.col("n") == 1, F.col(f"b_{k.lower()}")).otherwise(F.col(f"p_{k.lower()}")), F.lit(0)).alias(f"{k.lower()}s") for k in kinds],
                    F.when(F.col("n") == 1, F.coalesce("b_boleto", F.lit(0))).otherwise(F.size("slip_docs")).cast("bigint").alias("boletos"), (F.size("note_docs") + F.size("slip_docs")).alias("total_documents"))
