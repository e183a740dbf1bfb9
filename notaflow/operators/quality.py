"""Quality rules over documents and batches, and the reports made from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SEVERITY
from ..functions.text import positive, present


def problem(when: Column, kind: str, level: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(SEVERITY[level]).alias("severity")))


def exploded(df: DataFrame, problems: list[Column]) -> DataFrame:
    """A row for each problem of each row: kind, severity."""
    return df.withColumn("p", F.explode(F.array_compact(F.array(*problems)))).select("*", "p.kind", "p.severity").drop("p")


def bucket(severity: Column) -> Column:
    return F.when(severity >= 3, F.lit("CRITICA")).when(severity >= 2, F.lit("ALTA")).when(severity >= 1, F.lit("MEDIA")).otherwise(F.lit("BAIXA"))


def by_kind(problems: DataFrame, value: str) -> DataFrame:
    return problems.groupBy("kind").agg(F.max("severity").alias("max_severity"), F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).orderBy(F.desc("max_severity"), F.desc("n"), "kind")


def service_note_ok(number: Column, amount: Column) -> Column:
    return present(number) & positive(amount)


def reasons(number: Column, amount: Column, cnpj: Column, due: Column) -> Column:
    """Codes of what a service note lacks; some of them alone don't make it fail."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(present(number), F.lit(False)), F.lit("SEM_NUMERO")), F.when(~positive(amount), F.lit("VALOR_ZERO")),
        F.when(~F.coalesce(present(cnpj), F.lit(False)), F.lit("SEM_CNPJ")), F.when(due.isNull(), F.lit("SEM_VENCIMENTO"))))


def summary(df: DataFrame, amount: str, name: str, due: str) -> DataFrame:
    """One row: rows, how many have each field, and the shares."""
    have = {"with_value": positive(F.col(amount)), "with_name": F.coalesce(present(F.col(name)), F.lit(False)), "with_due": F.col(due).isNotNull()}
    out = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in have.items()])
    return out.select("*", *[F.round(100.0 * F.col(k) / F.nullif("total", F.lit(0)), 2).alias(f"pct_{k}") for k in have])


def with_samples(problems: DataFrame, value: Column, label: Column, order: Column, n: int = 3) -> DataFrame:
    """by_kind without mere information, with the first `n` labels of each kind."""
    from pyspark.sql import Window as W

    d = problems.where(F.col("severity") >= SEVERITY["BAIXA"]).withColumn("_i", F.row_number().over(W.partitionBy("kind").orderBy(order)))
    first = F.sort_array(F.collect_list(F.when(F.col("_i") <= n, F.struct("_i", label.alias("l")))))
    return d.groupBy("kind").agg(F.max("severity").alias("max_severity"), F.count("*").alias("n"), F.sum(value).alias("total"), F.transform(first, lambda x: x["l"]).alias("samples"))


def by_supplier(problems: DataFrame, name: str, value: Column, n: int = 10) -> DataFrame:
    """The suppliers with most value in problems: name, n, total, kinds."""
    g = problems.groupBy(name).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return g.orderBy(F.desc("total"), name).limit(n)
