"""Queries over batch health. Names and subjects are dealt to orders by their keys."""

from pyspark.sql import functions as F

from ..operators import health
from ..sources.tables import table

SUPPLIERS = ("CSC", "", "a@x.com", "Chave de acesso: 12", "ABC", "Marco Silva Lima", "CEMIG DISTRIBUICAO", "ALFA COMERCIO LTDA", "XY EMPREENDIMENTOS", None)
SUBJECTS = ("Boleto", "Comissão de vendas", "Encerramento de contrato", "Nota e Boleto", "Pagamento realizado", "NFCOM abril", "Oi")


def batches(spark, d):
    k = F.col("o_orderkey")
    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", pick(SUPPLIERS).alias("fornecedor"), pick(SUBJECTS).alias("email_subject"), F.when(k % 3 == 0, F.lit("2025-01-01")).otherwise("").alias("vencimento"), F.when(k % 17 == 0, 0.0).when(k % 19 == 0, 0.5).otherwise(F.col("o_totalprice")).alias("valor_compra"),
                    F.when(k % 4 == 0, 1).otherwise(0).alias("nfses"), F.when(k % 5 == 0, 1).otherwise(0).alias("boletos"), F.when(k % 6 < 4, 1).otherwise(0).alias("outros"), (k % 7 == 0).alias("pdf_protegido"))


def _list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


BATCHES_SQL = f"""b AS (SELECT o_orderkey, {_list(SUPPLIERS)}[o_orderkey % 10 + 1] AS f0, {_list(SUBJECTS)}[o_orderkey % 7 + 1] AS s, CASE WHEN o_orderkey % 3 = 0 THEN '2025-01-01' ELSE '' END AS due,
  CASE WHEN o_orderkey % 17 = 0 THEN 0.0 WHEN o_orderkey % 19 = 0 THEN 0.5 ELSE o_totalprice END AS v, o_orderkey % 4 = 0 AS nf, o_orderkey % 5 = 0 AS bo, o_orderkey % 6 < 4 AS ou, o_orderkey % 7 = 0 AS pdf FROM orders),
k AS (SELECT *, coalesce(f0, '') AS f, CASE WHEN nf THEN 'NFSE' WHEN bo THEN 'BOLETO' WHEN ou AND (s = 'Pagamento realizado') THEN 'COMPROVANTE_PAGAMENTO' WHEN ou AND f0 = 'XY EMPREENDIMENTOS' THEN 'OUTRO' WHEN ou AND f0 = 'CEMIG DISTRIBUICAO' THEN 'UTILITY_ENERGY' WHEN ou THEN 'OUTRO' ELSE 'EMAIL_BODY' END AS kind,
  s IN ('Boleto', 'Nota e Boleto', 'Pagamento realizado') AS slip FROM b),
n AS (SELECT *, v > 0 AND due = '' AS nd, s = 'NFCOM abril' AS tel, v < 50 AND f = 'XY EMPREENDIMENTOS' AS rent, bo OR s = 'Nota e Boleto' AS ins FROM k),
r AS (SELECT o_orderkey, kind AS main_kind, unnest(list_filter([
  CASE WHEN f = 'CSC' THEN 'FORNECEDOR_INTERNO' END, CASE WHEN v > 0 AND f = '' THEN 'FORNECEDOR_VAZIO' END, CASE WHEN v > 0 AND f = 'a@x.com' THEN 'FORNECEDOR_EMAIL' END, CASE WHEN f = 'Chave de acesso: 12' THEN 'FORNECEDOR_TEXTO_PDF' END,
  CASE WHEN v > 1000 AND length(f) < 10 THEN 'FORNECEDOR_CURTO' END, CASE WHEN v > 10000 AND f = 'Marco Silva Lima' AND s <> 'Comissão de vendas' THEN 'FORNECEDOR_PESSOA_VALOR_ALTO' END, CASE WHEN v > 10000 AND f = 'Marco Silva Lima' AND s = 'Comissão de vendas' THEN 'MEI_COMISSAO_OK' END,
  CASE WHEN nd AND kind = 'NFSE' AND slip THEN 'NFSE_SEM_VENCIMENTO' END, CASE WHEN nd AND kind = 'UTILITY_ENERGY' THEN CASE WHEN s = 'Encerramento de contrato' THEN 'UTILITY_ENCERRAMENTO' WHEN v < 1 THEN 'UTILITY_VALOR_ACUMULADO' ELSE 'UTILITY_SEM_VENCIMENTO' END END,
  CASE WHEN nd AND kind = 'EMAIL_BODY' THEN CASE WHEN pdf THEN 'PDF_PROTEGIDO_SEM_VENCIMENTO' WHEN slip THEN 'EMAIL_BODY_SEM_VENCIMENTO' END END, CASE WHEN nd AND kind = 'COMPROVANTE_PAGAMENTO' THEN 'COMPROVANTE_OK' END,
  CASE WHEN nd AND kind = 'OUTRO' THEN CASE WHEN tel THEN 'NFCOM_SEM_VENCIMENTO' WHEN rent THEN 'FATURA_LOCACAO_BAIXO_VALOR' WHEN ins THEN 'VENCIMENTO_NO_BOLETO' WHEN slip THEN 'VENCIMENTO_AUSENTE' END WHEN nd AND kind = 'BOLETO' AND slip THEN 'VENCIMENTO_AUSENTE' END], lambda x: x IS NOT NULL)) AS kind FROM n)"""


def batch_problems(spark, d):
    return health.problems(batches(spark, d)).select("o_orderkey", "main_kind", "kind")


def informative_counts(spark, d):
    return health.problems(batches(spark, d)).where("severity = 0.1").groupBy("kind").agg(F.count("*").alias("n"))


def problem_types(spark, d):
    o = table(spark, d, "orders")
    s = F.element_at(F.array(*map(F.lit, ("Lembrete gentil", "DANFE 1", "TCF Telecom", "Box Brazil", "Relatório x", "conta CEMIG", "faturamento", "nada"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return o.select("o_orderkey", health.problem_type(s, F.when(F.col("o_orderkey") % 16 == 0, F.lit("nota fiscal"))).alias("type"))


def supplier_validity(spark, d):
    return batches(spark, d).select("o_orderkey", health.valid_supplier(F.col("fornecedor")).alias("valid"), health.is_internal(F.col("fornecedor")).alias("internal"))


def zero_value_cases(spark, d):
    return health.zero_value_cases(batches(spark, d)).select("o_orderkey", "fornecedor")


QUERIES = {f.__name__: f for f in (batch_problems, informative_counts, problem_types, supplier_validity, zero_value_cases)}
_INFO = ("MEI_COMISSAO_OK", "NFSE_SEM_VENCIMENTO", "UTILITY_ENCERRAMENTO", "UTILITY_VALOR_ACUMULADO", "PDF_PROTEGIDO_SEM_VENCIMENTO", "COMPROVANTE_OK", "NFCOM_SEM_VENCIMENTO", "FATURA_LOCACAO_BAIXO_VALOR", "VENCIMENTO_NO_BOLETO")
SQL = {
    "batch_problems": f"WITH {BATCHES_SQL} SELECT o_orderkey, main_kind, kind FROM r",
    "informative_counts": f"WITH {BATCHES_SQL} SELECT kind, count(*) AS n FROM r WHERE kind IN {_INFO} GROUP BY kind",
    "problem_types": "SELECT o_orderkey, CASE WHEN o_orderkey % 16 = 0 THEN 'NFSE_MAL_CLASSIFICADA' ELSE ['OUTROS', 'DANFE_COMO_ADMIN', 'TCF_TELECOM_PROBLEM', 'BOX_BRAZIL_PROBLEM', 'RELATORIO_ADMIN', 'CEMIG_FATURA', 'FATURAMENTO_ADMIN', 'OUTROS'][o_orderkey % 8 + 1] END AS type FROM orders",
    "supplier_validity": f"WITH {BATCHES_SQL} SELECT o_orderkey, f NOT IN ('', 'a@x.com', 'Chave de acesso: 12') AS valid, f = 'CSC' AS internal FROM k",
    "zero_value_cases": f"WITH {BATCHES_SQL} SELECT o_orderkey, f0 AS fornecedor FROM b WHERE (ou OR nf) AND v = 0",
}
