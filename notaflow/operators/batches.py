"""Per-batch operators: totals, first values by priority, status, inheritance, duplicates, complement, grouping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import TOLERANCE
from ..functions.text import present
from ..sources.tables import dealt


def totals(docs: DataFrame, kinds: tuple[str, ...], key: str = "batch_id") -> DataFrame:
    """Per batch: documents, and amount and number of each kind."""
    parts = [c for k in kinds for c in (F.sum(F.when(F.col("doc_type") == k, F.coalesce("valor", F.lit(0.0))).otherwise(0.0)).alias(f"total_{k.lower()}"), F.count_if(F.col("doc_type") == k).alias(f"n_{k.lower()}"))]
    return docs.groupBy(key).agg(F.count("*").alias("total_documents"), *parts)


def first_by_priority(docs: DataFrame, value: str, kinds: tuple[str, ...], keep: Column, out: str, key: str = "batch_id") -> DataFrame:
    """Per batch the value of the first kept document in order of kind, then of doc_seq; null without one."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("doc_type"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("doc_type").alias("k")), F.when(keep & (rank > 0), F.struct(rank, F.col("doc_seq"))))
    return docs.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(out), F.col("b.k").alias(f"{out}_source"))


def status(purchase: Column, slip: Column) -> tuple[Column, Column]:
    """Status of a batch and the rounded difference."""
    diff = F.round(F.coalesce(purchase, F.lit(0.0)) - F.coalesce(slip, F.lit(0.0)), 2)
    both = (F.coalesce(purchase, F.lit(0.0)) > 0) & (F.coalesce(slip, F.lit(0.0)) > 0)
    return F.when(both & (F.abs(diff) <= TOLERANCE), F.lit("CONCILIADO")).when(both, F.lit("DIVERGENTE")).otherwise(F.lit("CONFERIR")), diff


def inherit(docs: DataFrame, key: str = "batch_id", rows: int = 1_500_000) -> DataFrame:
    """Slips take the first note number of their batch, notes the first slip due date, all the first order number. A task sorts
    about `rows` documents."""
    w = W.partitionBy(key).orderBy("doc_seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    note, slip = F.col("doc_type").isin("DANFE", "NFSE"), F.col("doc_type") == "BOLETO"
    number = F.first(F.when(note & present(F.col("numero")), F.col("numero")), True).over(w)
    due = F.first(F.when(slip, F.col("vencimento")), True).over(w)
    order = F.first(F.when(present(F.col("numero_pedido")), F.col("numero_pedido")), True).over(w)
    return dealt(docs, key, "doc_seq", rows=rows).select(
        *[c for c in docs.columns if c not in ("referencia_nfse", "vencimento", "numero_pedido")],
        F.when(slip & ~F.coalesce(present(F.col("referencia_nfse")), F.lit(False)), number).otherwise(F.col("referencia_nfse")).alias("referencia_nfse"),
        F.when(note, F.coalesce("vencimento", due)).otherwise(F.col("vencimento")).alias("vencimento"),
        F.coalesce(F.when(present(F.col("numero_pedido")), F.col("numero_pedido")), order).alias("numero_pedido"))


def inherit_all(docs: DataFrame, mails: DataFrame | None = None, key: str = "batch_id", rows: int = 1_000_000) -> DataFrame:
    """docs with what a batch's documents take from each other. Slips without a reference take the first goods note's
    number, else the first service note's, else the first other document's; notes without a due date take the first
    slip's, and where no note and slip meet with one, every document without takes the mail's. All documents take the
    first order number (an other document's own number counts as one), and where no document has a number, the mail's.

    docs: doc_seq, doc_type, numero, numero_pedido, referencia_nfse, vencimento; mails: vencimento_email, numero_email.
    A task sorts about `rows` documents and mails; the mails come after the windows, so that documents are sorted once.
    """
    w = W.partitionBy(key).orderBy("doc_seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kind, slip, other = F.col("doc_type"), F.col("doc_type") == "BOLETO", F.col("doc_type") == "OUTRO"
    note = kind.isin("DANFE", "NFSE")
    own = {c: F.nullif(F.col(c), F.lit("")) for c in ("numero", "numero_pedido", "referencia_nfse")}

    def first(value: Column, where: Column) -> Column:
        return F.first(F.when(where, value), True).over(w)

    mail_due, mail_number = (F.lit(None), F.lit(None)) if mails is None else (F.col("vencimento_email"), F.nullif("numero_email", F.lit("")))
    d = dealt(docs, key, "doc_seq", *([] if mails is None else [mails]), rows=rows).withColumns({
        "_ref": F.coalesce(first(own["numero"], kind == "DANFE"), first(own["numero"], kind == "NFSE"), first(own["numero"], other)), "_due": first(F.col("vencimento"), slip),
        "_notes": F.max(note).over(w), "_order": first(F.when(other, own["numero"]).otherwise(own["numero_pedido"]), F.lit(True)),
        "_number": F.coalesce(first(own["numero"], note | slip | other), first(own["numero_pedido"], note))})
    d = d if mails is None else d.join(mails.select(key, "vencimento_email", "numero_email"), key, "left")
    inherited = F.col("_due").isNotNull() & F.col("_notes")
    due = F.coalesce("vencimento", F.when(note, F.col("_due")), F.when(~F.coalesce(inherited, F.lit(False)), mail_due.cast("date")))
    number = F.coalesce(own["numero"], F.when(other, F.col("_order")), F.when(F.col("_number").isNull(), mail_number.cast("string")))
    taken = {"referencia_nfse": F.when(slip, F.coalesce(own["referencia_nfse"], "_ref")).otherwise(F.col("referencia_nfse")), "vencimento": due, "numero_pedido": F.when(other, F.col("numero_pedido")).otherwise(F.coalesce(own["numero_pedido"], "_order")), "numero": number}
    return d.select(*[taken[c].alias(c) if c in taken else F.col(c) for c in docs.columns])


def status_text(purchase: Column, slip: Column, repeated: Column, same_values: Column, admin: Column, generic: Column) -> tuple[Column, Column]:
    """Status of a batch and what there is to say of it; null for nothing. repeated: numbers that were forwarded twice;
    same_values: whether supplier and amount were; admin: what an administrative subject announces; generic: whether the
    amount comes from a document of no known kind."""
    state, diff = status(purchase, slip)
    c, b = (F.coalesce(x, F.lit(0.0)) for x in (purchase, slip))
    twice = F.when(F.size(F.coalesce(repeated, F.array().cast("array<string>"))) > 0, F.concat(F.lit("[ENCAMINHAMENTO DUPLICADO - notas: "), F.array_join(repeated, ", "), F.lit("]"))).when(same_values, F.lit("[ENCAMINHAMENTO DUPLICADO - mesmos valores detectados]"))
    text = (F.when(state == "CONCILIADO", F.regexp_replace(twice, r"^[\s\[\]]+|[\s\[\]]+$", ""))
            .when(state == "DIVERGENTE", F.concat_ws(" ", F.format_string("Valor compra: R$ %.2f | Valor boleto: R$ %.2f | Diferença: R$ %.2f", c, b, diff), twice))
            .when((b > 0) & ~(c > 0), F.concat_ws(" ", F.format_string("Conferir boleto (R$ %.2f) - NF sem valor encontrada", b), twice))
            .otherwise(F.concat_ws(" ", F.format_string("Conferir valor (R$ %.2f) - sem boleto para comparação", c), twice)))
    told = F.concat_ws(" ", text, F.concat(F.lit("[POSSÍVEL DOCUMENTO ADMINISTRATIVO - "), admin, F.lit("]")), F.when(generic, F.lit("[VALOR EXTRAÍDO DE DOCUMENTO GENÉRICO - conferir manualmente]")))
    return state, F.nullif(told, F.lit(""))


def duplicates(docs: DataFrame, keys: list[Column], ids: str) -> DataFrame:
    """Keys that occur more than once, with how often and the smallest id."""
    return docs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ids).alias("first_id")).where("n > 1")


def complement_near(main: DataFrame, extra: DataFrame, keys: list[str], number: str, width: int, main_id: str, extra_id: str, fill: list[str]) -> DataFrame:
    """main_id, extra_id and the columns in `fill` for every row of main, those that are null taken from the row of extra
    with the smallest id among those of equal keys, another id, and a whole number less than `width` away.

    extra has the same names as main, but for its id. Its two smallest ids of each (keys, number) go through one window a
    key, so that no pair is listed: the work grows with the different numbers, not with the rows that share them.
    """
    w = W.partitionBy(*keys, number).orderBy(extra_id)
    e = extra.groupBy(*keys, number, extra_id).agg(F.min(F.struct(*fill)).alias("_f")).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    e = e.groupBy(*keys, number).agg(F.collect_list(F.struct(F.col(extra_id).alias("id"), F.col("_f").alias("f"))).alias("_two"))
    at = main.select(*keys, number).distinct().join(e, [*keys, number], "full")
    near = F.flatten(F.collect_list(F.coalesce("_two", F.array().cast(e.schema["_two"].dataType))).over(W.partitionBy(*keys).orderBy(number).rangeBetween(1 - width, width - 1)))
    at = at.select(*keys, number, F.slice(F.array_sort(near), F.lit(1), F.lit(2)).alias("_near"))
    both = main.join(at, [*keys, number], "left")
    pick = both.withColumn("_x", F.get(F.filter("_near", lambda x: x["id"] != F.col(main_id)), F.lit(0)))
    return pick.select(main_id, F.col("_x.id").alias(extra_id), *[F.coalesce(c, F.col(f"_x.f.{c}")).alias(c) for c in fill])


def group_attachments(parts: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row a mail with its parts in order, numbered from 1."""
    return parts.groupBy(key).agg(F.count("*").alias("n_parts"), F.sort_array(F.collect_list(F.struct(order, *columns))).alias("parts"))


def numbered(parts: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Names prefixed by their two-digit place in the mail."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    return parts.withColumn("n", n).withColumn("file_name", F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("_"), F.col(name)))


def merged(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Current rows win over stored ones; of stored ones with the same key one stays."""
    return current.unionByName(stored.join(current, key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def retry(ledger: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Distinct open entries of the timeout ledger."""
    return ledger.select(key).distinct().join(resolved, key, "left_anti")


def repeated_lines(docs: DataFrame, key: str, line: str, order: list) -> DataFrame:
    """docs with `repeated`: the second and later occurrence of the same digits in a batch."""
    return docs.withColumn("repeated", F.row_number().over(W.partitionBy(key, line).orderBy(*order)) > 1)


def enriched(docs: DataFrame, mails: DataFrame, key: str = "batch_id") -> DataFrame:
    """docs whose empty supplier, number and order number come from their batch's mail (mail_fornecedor, mail_cnpj,
    mail_pedido). Spark broadcasts the mails only where their size allows."""
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"mail_{m}")) for c, m in (("fornecedor_nome", "fornecedor"), ("cnpj", "cnpj"), ("numero_pedido", "pedido"))}
    return docs.join(mails, key, "left").select(*[filled[c].alias(c) if c in filled else F.col(c) for c in docs.columns])


def with_subjects(docs: DataFrame, subjects: DataFrame, key: str = "batch_id") -> DataFrame:
    """docs whose mail subject is the one of the map (key, subject) where that has one."""
    got = subjects.select(key, F.nullif("subject", F.lit("")).alias("_subject"))
    return docs.join(got, key, "left").select(*[F.coalesce("_subject", c).alias(c) if c == "email_subject" else F.col(c) for c in docs.columns])


def consolidated(mails: DataFrame, subject: Column, batch: str) -> DataFrame:
    """Mails of one subject (blanks and case aside) become one batch: subject, how many, the first batch."""
    name = F.lower(F.regexp_replace(subject, r"\s+", " "))
    return mails.groupBy(name.alias("subject")).agg(F.count("*").alias("n"), F.min(batch).alias("batch")).where("n > 1")


def retained(batches: DataFrame, made: str, now: Column, hours: int = 48) -> DataFrame:
    """Batches older than that; they are listed, deleting is left to who owns them."""
    return batches.where(F.col(made) < now - F.make_dt_interval(hours=F.lit(hours)))
