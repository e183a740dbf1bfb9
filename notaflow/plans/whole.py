"""Queries of the same operators as reader_choice, consolidate, complement_left, merge_partial, vector_topk, company_match and
diagnostics_by_file, on whole texts and tables."""

from pyspark.sql import functions as F

from ..operators import batches, context, vectors
from ..sources import tables
from ..sources.tables import spread, table
from . import lines, runs
from .context import _INCOMPLETE


def reader_choice_whole(spark, d):
    """English documents come from the table reader, all others from the text layer."""
    t, tabular = F.col("text"), F.col("lang").eqNullSafe("en")
    native = F.when(~tabular, t)
    out = context.best_text(native, F.when(tabular, t), F.lit("digitalizado " * 5))
    return table(spark, d, "documents").select("doc_id", context.looks_incomplete(native).alias("incomplete"), F.length(out).alias("n"))


def consolidate_whole(spark, d):
    """Mails with the same whole subject become one batch."""
    c = table(spark, d, "conversations").where("turn = 0")
    subject = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    return c.groupBy(F.md5(subject).alias("subject_md5")).agg(F.count("*").alias("n"), F.min("conv_id").alias("batch"))


def complement_whole(spark, d):
    """Every document against every other one of its source and about its length."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    main = docs.withColumn("lang", F.when(F.col("n_chars") > 500, F.col("lang")))
    return batches.complement_near(main, docs.withColumnRenamed("doc_id", "x_id"), ["source"], "n_chars", 50, "doc_id", "x_id", ["lang"])


def merge_whole(spark, d):
    """Finished orders are current, all orders are stored, twice."""
    o = table(spark, d, "orders")
    current = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("current").alias("origin"))
    old = o.select("o_orderkey", F.lit("stored").alias("origin"))
    return batches.merged(current, old.unionAll(old), "o_orderkey")


def vector_topk_whole(spark, d):
    """The 5 nearest rows, itself among them, of each row whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    hit = vectors.nearest_all(v, v.where("vec_id % 20 = 0"), 5)
    return hit.select("query_id", "rank", "vec_id", F.round("distance", 4).alias("distance"))


def consolidated_mails(spark, d):
    """Texts that several documents have, as subjects, and the batch that takes them."""
    out = batches.consolidated(table(spark, d, "documents").where("text IS NOT NULL"), F.trim("text"), "doc_id")
    return out.select(F.md5("subject").alias("subject_md5"), "n", "batch")


def company_match_whole(spark, d):
    """The own company in a text of every order."""
    return lines.matched_companies(spread(table(spark, d, "orders")), lines._own(spark, d))


def diagnostics_by_file_whole(spark, d):
    """Messages by file and severity over all events."""
    e = table(spark, d, "events")
    file, severity = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("f"), F.col("user_id") % 7)), F.when(F.col("event_type") != "view", F.upper("event_type"))
    return tables.counts_by_file(e.select(file.alias("file"), severity.alias("severity"), F.col("event_id").cast("string").alias("message")))


def distinct_in_order(spark, d):
    """The different words of a text in the order of their first places."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+"), lambda w: w != ""))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("words_md5"))


QUERIES = {f.__name__: f for f in (consolidated_mails, company_match_whole, diagnostics_by_file_whole, distinct_in_order, reader_choice_whole, consolidate_whole, complement_whole, merge_whole, vector_topk_whole)}
SQL = {
    "consolidated_mails": r"SELECT md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS subject_md5, count(*) AS n, min(doc_id) AS batch FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "company_match_whole": lines.SQL["company_match"].replace(" WHERE o_orderkey % 2 = 1", ""),
    "diagnostics_by_file_whole": runs.SQL["diagnostics_by_file"].replace("WHERE event_id % 10 < 3 ", ""),
    "distinct_in_order": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS words_md5 FROM f""",
    "reader_choice_whole": r"""WITH t AS (SELECT doc_id, CASE WHEN lang IS DISTINCT FROM 'en' THEN text END AS native, CASE WHEN lang = 'en' THEN text END AS tab FROM documents),
c AS (SELECT doc_id, coalesce(native, '') AS x, CASE WHEN length(native) >= 50 THEN native WHEN length(tab) >= 50 THEN tab END AS pick FROM t),
f AS (SELECT doc_id, pick, trim(regexp_replace(x, '\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(pick, ''), '\s+', ' ', 'g')) AS b FROM c)
SELECT doc_id, """ + _INCOMPLETE.format(v="a") + " AS incomplete, CAST(CASE WHEN pick IS NULL THEN 65 WHEN " + _INCOMPLETE.format(v="b") + " THEN length(pick) + 66 ELSE length(pick) END AS INTEGER) AS n FROM f",
    "consolidate_whole": r"SELECT md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS subject_md5, count(*) AS n, min(conv_id) AS batch FROM conversations WHERE turn = 0 GROUP BY 1",
    "complement_whole": """WITH m AS (SELECT doc_id, source, CASE WHEN n_chars > 500 THEN lang END AS lang, n_chars FROM documents),
j AS (SELECT m.doc_id, x.doc_id AS x_id, coalesce(m.lang, x.lang) AS lang, row_number() OVER (PARTITION BY m.doc_id ORDER BY x.doc_id NULLS LAST) AS i FROM m LEFT JOIN documents x ON m.source = x.source AND m.doc_id <> x.doc_id AND abs(m.n_chars - x.n_chars) < 50)
SELECT doc_id, x_id, lang FROM j WHERE i = 1""",
    "merge_whole": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'current' ELSE 'stored' END AS origin FROM orders",
    "vector_topk_whole": "WITH x AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS dist FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM x) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 4) AS distance FROM r WHERE rank <= 5",
}
