"""Batch and file sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df dealt to all cores, and to as many parts that none has many more than `rows` rows: for work that costs much more than
    reading, so that a task's time does not grow with the table. Parquet counts its rows by its footers."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def dealt(df: DataFrame, key: str, order: str, *joined: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df dealt by key to all cores, and to as many parts that one has about `rows` rows of it and of what it will be joined with by
    key, in order of key and `order` there: windows by key need no other shuffle or sort, and what a task sorts does not grow with
    the tables. Rows of one key stay together. Above 200 parts Spark also sorts what it writes, a split of the input a task."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(d.count() for d in (df, *joined)) // rows))
    return df.repartition(parts, key).sortWithinPartitions(key, order)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line_no: the lines of text files; numbers rise within a split, not over splits (ordered_lines numbers files)."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def semicolon_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=schema, encoding="UTF-8", mode="PERMISSIVE")


def json_lines(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=multi_line, mode="PERMISSIVE")


def attachment_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, name, content of processable files, in name order within a batch."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.withColumn("name", F.substring_index("path", "/", -1)).where(processable(F.col("path")))


def processable(path) -> "F.Column":
    """PDF and XML files that are neither hidden, nor housekeeping, nor below ignored/."""
    name = F.lower(F.substring_index(path, "/", -1))
    junk = name.isin("metadata.json", ".gitkeep", "thumbs.db", "desktop.ini") | name.startswith(".") | F.contains(path, F.lit("/ignored/"))
    return ~junk & name.rlike(r"\.(pdf|xml)$")


def header_csv(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon file as text columns, named by its header; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8", mode="PERMISSIVE", multiLine=True)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The named columns, absent ones as nulls; amounts ('money') and dates that don't parse are null."""
    from ..functions.money import sheet_number

    def made(c: str, kind: str):
        if c not in df.columns:
            return F.lit(None).cast("double" if kind == "money" else kind).alias(c)
        return (sheet_number(F.col(c)) if kind == "money" else F.col(c).try_cast(kind)).alias(c)

    return df.select(*[made(c, k) for c, k in kinds.items()])


DOCUMENTS = dict.fromkeys(("tipo_documento", "arquivo_origem", "empresa", "fornecedor_nome", "numero_nota", "numero_documento", "status_conciliacao", "observacoes", "email_subject", "batch_id"), "string") | {"data_processamento": "date", "vencimento": "date", "valor_total": "money", "valor_documento": "money"}
BATCHES = dict.fromkeys(("batch_id", "status_conciliacao", "divergencia", "fornecedor", "numero_nota", "email_subject", "email_sender", "empresa", "source_folder"), "string") | {"data": "date", "vencimento": "date", "diferenca_valor": "money", "valor_compra": "money", "valor_boleto": "money"} | dict.fromkeys(("total_documents", "total_errors", "danfes", "boletos", "nfses", "outros", "avisos"), "int")
NOTICES = dict.fromkeys(("tipo_documento", "arquivo_origem", "empresa", "fornecedor_nome", "numero_nota", "link_nfe", "codigo_verificacao", "dominio_portal", "email_subject", "observacoes", "status_conciliacao"), "string") | {"data_processamento": "date", "email_date": "date", "vencimento": "date"}


def documents_csv(spark: SparkSession, path: str) -> DataFrame:
    d = typed(header_csv(spark, path), DOCUMENTS)
    return d.withColumn("doc_type", F.upper(F.coalesce("tipo_documento", F.lit(""))))


def notices_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed(header_csv(spark, path), NOTICES)


def health_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed(header_csv(spark, path), BATCHES)


def batches_csv(spark: SparkSession, path: str, today) -> DataFrame:
    return batch_rows(health_csv(spark, path), today)


def batch_rows(b: DataFrame, today) -> DataFrame:
    """Exported batches as documents: the slips' amount if there is one, else the purchase's; processed on the day in the
    batch's name, else today; status and divergence as remarks."""
    part = F.get(F.split("batch_id", "_"), F.lit(1))
    day = F.when(F.length(part) == 8, F.to_date(F.try_to_timestamp(part, F.lit("yyyyMMdd"))))
    remarks = F.nullif(F.concat_ws(" | ", F.concat(F.lit("["), F.nullif("status_conciliacao", F.lit("")), F.lit("]")), F.nullif("divergencia", F.lit(""))), F.lit(""))
    return b.select(F.coalesce("batch_id", F.lit("")).alias("arquivo_origem"), F.coalesce(day, today).alias("data_processamento"), F.col("data").alias("email_date"), "empresa", F.col("fornecedor").alias("fornecedor_nome"),
                    F.nullif("numero_nota", F.lit("")).alias("numero_documento"), F.when(F.col("valor_boleto") > 0, F.col("valor_boleto")).otherwise(F.col("valor_compra")).alias("valor_total"), "vencimento", "status_conciliacao", remarks.alias("observacoes"), "email_subject", "batch_id")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value: lines numbered within their file, whatever splits it is read in. Files are read whole, one task
    each, so this is for logs, whose files are rotated."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def in_path_order(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """doc_seq: a file's place in the name order of its batch, from 1."""
    from pyspark.sql import Window as W

    return files.withColumn("doc_seq", F.row_number().over(W.partitionBy(key).orderBy(path)))


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """file, severity, n, messages of a JSON report of diagnostics."""
    d = spark.read.json(path, schema="generalDiagnostics array<struct<file:string,severity:string,message:string>>", multiLine=True)
    return by_file_and_severity(d.select(F.explode("generalDiagnostics").alias("d")).select("d.*"))


def by_file_and_severity(d: DataFrame) -> DataFrame:
    g = d.groupBy(F.coalesce("file", F.lit("unknown")).alias("file"), F.lower(F.coalesce("severity", F.lit("information"))).alias("severity"))
    return g.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("message")).alias("messages"))


def counts_by_file(d: DataFrame) -> DataFrame:
    """The same without the messages: how many, and the first."""
    return d.groupBy(F.coalesce("file", F.lit("unknown")).alias("file"), F.lower(F.coalesce("severity", F.lit("information"))).alias("severity")).agg(F.count("*").alias("n"), F.min("message").alias("first"))


ISSUES = {"value": "Valor Issues:", "vencimento": "Vencimento Issues:", "fornecedor": "Fornecedor Issues:", "numero_nota": "Numero Nota Issues:", "extractor_identification": "Extrator Identification Issues:", "data_validation": "Data Validation Issues:"}


def report_cases(reports: DataFrame, text: str = "text") -> DataFrame:
    """A row for each case of text reports: severity, a flag for each kind of issue, classification and action. Cases begin
    with a line of 80 dashes; what stands before the first is a heading."""
    case = F.explode(F.slice(F.split(text, r"(?m)^-{80}"), F.lit(2), F.lit(2**31 - 1)))
    c = reports.select(case.alias("case"))
    word = F.upper(F.nullif(F.regexp_extract("case", r"Nível de severidade:\s*(\w+)", 1), F.lit("")))
    label = F.regexp_extract("case", r"Classificação primária: *(\S*)", 1)
    kind = F.when(label == "DESCONHECIDO", F.lit("unknown")).when(label.startswith("NFSE"), F.lit("nfse")).when(F.contains("case", F.lit("Classificação primária:")) & F.contains("case", F.lit("administrativos")), F.lit("administrativos")).when(label.startswith("BOLETO"), F.lit("boleto"))
    action = F.coalesce(*[F.when(F.contains("case", F.lit(f"Ação recomendada: {a}")), F.lit(a.lower())) for a in ("INVESTIGAR_MANUALMENTE", "MELHORAR_EXTRACAO", "CORRIGIR_VALORES")])
    return c.select(F.when(word.isin("ALTA", "MEDIA", "BAIXA"), word).alias("severity"), *[F.contains("case", F.lit(mark)).alias(f"issue_{name}") for name, mark in ISSUES.items()], kind.alias("classification"), action.alias("action"))


def report_totals(reports: DataFrame, text: str = "text") -> DataFrame:
    """One row of counts over the cases of text reports."""
    c = report_cases(reports, text)
    by = [F.count_if(F.col(f"issue_{n}")).alias(f"issue_{n}") for n in ISSUES]
    for column, values in (("severity", ("ALTA", "MEDIA", "BAIXA")), ("classification", ("unknown", "nfse", "administrativos", "boleto")), ("action", ("investigar_manualmente", "melhorar_extracao", "corrigir_valores"))):
        by += [F.count_if(F.col(column) == v).alias(f"{column}_{v.lower()}") for v in values]
    return c.agg(F.count("*").alias("total_cases"), *by)
