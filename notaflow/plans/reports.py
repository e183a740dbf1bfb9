"""Queries over ordered events, mail and vectors, and the streaming ones."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import batches, context, logs, mail, vectors
from ..session import shared_dir
from ..sources import mail as inbox
from ..sources.tables import processable, table


def events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def log_carry_forward(spark, d):
    e = logs.carried(events(spark, d), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "batch")
    return e.select("event_id", "user_id", "batch")


def sessions(spark, d):
    e = logs.sessions(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", "ts")
    return e.select("user_id", "session", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"))


def slow_flag(spark, d):
    return logs.slow(events(spark, d), "user_id", "value", F.struct("ts", "event_id"))


def log_levels(spark, d):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("INFO")
    return logs.levels(events(spark, d), "event_type", level, "ts")


def multi_line_records(spark, d):
    e = events(spark, d)
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - core - INFO - "), "event_type")
    lines = e.select("user_id", "event_id", F.when(F.col("event_type").isin("error", "purchase"), head).otherwise(F.concat(F.lit("  at "), "event_type")).alias("value"))
    r = logs.records(lines, "user_id", "event_id")
    return r.groupBy("user_id").agg(F.count("*").alias("records"), F.sum(F.size(F.split("message", "\n"))).alias("lines"), F.count_if(F.col("level") == "INFO").alias("infos"))


def histogram_cumulative(spark, d):
    return logs.histogram(events(spark, d), "event_type", "value")


def counter_gauge(spark, d):
    e = events(spark, d)
    return logs.counters_and_gauges(e, ["event_type", (F.col("user_id") % 3).alias("label")], "value", F.struct("ts", "event_id"))


def running_progress(spark, d):
    return logs.progress(events(spark, d), "user_id", ["ts", "event_id"]).select("event_id", "i", "n", "percent")


def mails(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", "html")
    k = F.col("page_id") % 8
    subject = F.element_at(F.array(*map(F.lit, ("Nota Fiscal 123", "Feliz Natal", "Sua fatura chegou", "Reuniao", "RE: FW: boleto", "Newsletter", "Envio de documento", "Conta de luz"))), (k + 1).cast("int"))
    sender = F.element_at(F.array(*map(F.lit, ("nfe@omie.com.br", "a@github.com", "x@empresa.com", "financeiro@y.com", "no@mail.mailchimp.com"))), (F.col("page_id") % 5 + 1).cast("int"))
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("veja https://portal.nfse.example/"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("codigo: AB12CD"), F.lpad(F.col("page_id").cast("string"), 6, "0"))).otherwise(F.lit("sem nada"))
    files = F.when(F.col("page_id") % 7 == 0, F.array(F.lit("image001.png"), F.lit("NF.pdf"))).otherwise(F.array(F.lit("logo.png")))
    return p.select("page_id", subject.alias("subject"), sender.alias("sender"), body.alias("body"), files.alias("files"))


MAIL_SQL = """m AS (SELECT page_id, ['Nota Fiscal 123', 'Feliz Natal', 'Sua fatura chegou', 'Reuniao', 'RE: FW: boleto', 'Newsletter', 'Envio de documento', 'Conta de luz'][page_id % 8 + 1] AS subject,
  ['nfe@omie.com.br', 'a@github.com', 'x@empresa.com', 'financeiro@y.com', 'no@mail.mailchimp.com'][page_id % 5 + 1] AS sender, page_id % 7 = 0 AS att, page_id % 3 = 0 AS link, page_id % 3 = 1 AS code FROM pages)"""


def _any(column: str, patterns) -> str:
    return f"regexp_matches({column}, '(?i)(?:" + "|".join(p.replace("'", "''") for p in patterns) + ")')"


DECISION_SQL = f"CASE WHEN att THEN 'PROCESS' WHEN {_any('sender', fixed.SENDER_BLACK)} THEN 'SKIP_SENDER_BLACKLIST' WHEN {_any('subject', fixed.SUBJECT_BLACK)} THEN 'SKIP_BLACKLIST' WHEN NOT (link OR code) THEN 'SKIP_NO_CONTENT' WHEN {_any('subject', fixed.SUBJECT_WHITE)} OR {_any('sender', fixed.SENDER_WHITE)} THEN 'PROCESS' ELSE 'SKIP_NO_SUBJECT_MATCH' END"


def email_filter(spark, d):
    m = mails(spark, d)
    att, link, code = mail.has_attachment(F.col("files")), mail.has_link(F.col("body")), mail.has_code(F.col("body"))
    return m.select("page_id", mail.decision(F.col("subject"), F.col("sender"), att, link, code).alias("decision"), mail.content_type(att, link, code).alias("content_type"), F.size(mail.whitelist_matches(F.col("subject"))).alias("hits"))


def filter_counts(spark, d):
    return mail.split_batch(email_filter(spark, d))[2]


def link_code_detect(spark, d):
    m = mails(spark, d)
    return m.select("page_id", mail.has_link(F.col("body")).alias("link"), mail.has_code(F.col("body")).alias("code"), mail.ignored_attachment(F.col("files")[0]).alias("ignored"), processable(F.concat(F.lit("/in/"), F.element_at("files", -1))).alias("processable"))


def group_attachments(spark, d):
    g = batches.group_attachments(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return g.select("conv_id", "n_parts", F.array_join(F.transform("parts", lambda p: F.concat(F.lpad(p["turn"].cast("string"), 2, "0"), F.lit("_"), p["role"])), "|").alias("names"), F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("body"))


def numbered_attachments(spark, d):
    return batches.numbered(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "n", "file_name")


def anti_scan(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "email_id")
    return inbox.without_attachments(c, c.where(F.length("text") > 400)).groupBy(F.col("email_id").alias("conv_id")).agg(F.count("*").alias("n"))


def consolidate(spark, d):
    """Mails with the same subject become one batch."""
    c = table(spark, d, "conversations").where("turn = 0")
    return batches.consolidated(c, F.left(F.trim("text"), F.lit(3)), "conv_id")


def sender_and_body(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" <"), "role", F.lit("@x.com>")).alias("sender"), F.concat_ws(f"\n{fixed.HTML_MARK}\n", "text", F.lit("<p>x</p>")).alias("body"))
    return c.select("conv_id", "turn", inbox.sender(F.col("sender")).alias("s"), inbox.html_part(F.col("body")).alias("html")).select("conv_id", "turn", "s.address", "s.name", "html")


def router(spark, d):
    """Ordered rules over the text; the first that accepts wins."""
    t = F.lower("text")
    rules = (("TABLE", F.contains(t, F.lit(" | "))), ("SHOUT", F.contains(t, F.lit("!!"))), ("LICENSE", t.rlike("license")), ("TOKEN", t.rlike("token = ")), ("MAIL", F.contains(t, F.lit("@"))))
    out = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit("GENERIC"))
    return table(spark, d, "documents").select("doc_id", out.alias("extractor"))


def content_score(spark, d):
    found, confidence = context.content_scores(F.col("text"), {"english": ("the ", "of ", "and "), "german": ("der ", "die ", "und ")})
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in found.items()], confidence.alias("confidence"))


def inbox_stats(spark, d):
    return mail.keyword_counts(table(spark, d, "documents"), "text", "source", ("license", "token", "@"))


def sample_ids(spark, d):
    return mail.samples(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id")


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    query = v.where("vec_id = 0").select("embedding").first()[0]
    return vectors.nearest(v, query, 5).select("vec_id", F.round("distance", 4).alias("distance"), F.round("relevance", 4).alias("relevance"))


def incremental_dedupe(spark, d):
    """Events delivered twice, ingested in two runs over one checkpoint: each comes once."""
    from uuid import uuid4

    from ..streaming.ingest import run_once

    base = f"{shared_dir(spark)}/ingest-{uuid4().hex}"
    e = events(spark, d)
    e.where("event_id % 3 <> 0").write.parquet(f"{base}/in/a")
    schema = e.schema
    run_once(spark, f"{base}/in/*", schema, f"{base}/out", f"{base}/state", "event_id", "ts")
    e.where("event_id % 2 = 0 OR event_id % 3 = 0").write.parquet(f"{base}/in/b")
    run_once(spark, f"{base}/in/*", schema, f"{base}/out", f"{base}/state", "event_id", "ts")
    return spark.read.schema(schema).parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


QUERIES = {f.__name__: f for f in (log_carry_forward, sessions, slow_flag, log_levels, multi_line_records, histogram_cumulative, counter_gauge, running_progress, email_filter, filter_counts, link_code_detect, group_attachments, numbered_attachments, anti_scan, consolidate, sender_and_body, router, content_score, inbox_stats, sample_ids, vector_topk, incremental_dedupe)}
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_CELLS = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in fixed.HISTOGRAM_BOUNDS)
SQL = {
    "log_carry_forward": f"SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) {_W} AS batch FROM events",
    "sessions": f"WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {_W} AS session FROM events) SELECT user_id, CAST(session AS BIGINT) AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(min(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS ended FROM s WHERE session > 0 GROUP BY user_id, session HAVING count(*) FILTER (event_type = 'purchase') > 0",
    "slow_flag": "SELECT user_id, arg_max(value, (ts, event_id)) AS last_duration, arg_max(value, (ts, event_id)) > 20 AS slow FROM events GROUP BY user_id",
    "log_levels": "SELECT event_type, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type NOT IN ('error', 'view')) AS infos, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY event_type",
    "multi_line_records": "WITH h AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) SELECT user_id, count(DISTINCT r) AS records, count(*) AS lines, count(DISTINCT r) AS infos FROM h WHERE r > 0 GROUP BY user_id",
    "histogram_cumulative": f"SELECT event_type, {_CELLS}, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
    "counter_gauge": "SELECT event_type, user_id % 3 AS label, count(*) AS counter, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY 1, 2",
    "running_progress": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS i, count(*) OVER (PARTITION BY user_id) AS n, round(100.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id), 2) AS percent FROM events",
    "email_filter": f"WITH {MAIL_SQL} SELECT page_id, {DECISION_SQL} AS decision, CASE WHEN att THEN 'COM_ANEXO' WHEN link THEN 'LINK_DOWNLOAD' WHEN code THEN 'APENAS_CODIGO' ELSE 'IRRELEVANTE' END AS content_type, " + " + ".join(f"CAST({_any('subject', (p,))} AS INTEGER)" for p in fixed.SUBJECT_WHITE) + " AS hits FROM m",
    "filter_counts": f"WITH {MAIL_SQL} SELECT {DECISION_SQL} AS decision, count(*) AS n FROM m GROUP BY 1",
    "link_code_detect": f"WITH {MAIL_SQL} SELECT page_id, link, code, true AS ignored, att AS processable FROM m",
    "group_attachments": "SELECT conv_id, count(*) AS n_parts, string_agg(lpad(CAST(turn AS VARCHAR), 2, '0') || '_' || role, '|' ORDER BY turn, role, text) AS names, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS body FROM conversations GROUP BY conv_id",
    "numbered_attachments": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 2, '0') || '_' || role AS file_name FROM conversations",
    "anti_scan": "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE length(text) > 400) GROUP BY conv_id",
    "consolidate": r"SELECT lower(regexp_replace(left(trim(text), 3), '\s+', ' ', 'g')) AS subject, count(*) AS n, min(conv_id) AS batch FROM conversations WHERE turn = 0 GROUP BY 1 HAVING count(*) > 1",
    "sender_and_body": "SELECT conv_id, turn, role || '@x.com' AS address, role AS name, '<p>x</p>' AS html FROM conversations",
    "router": "SELECT doc_id, CASE WHEN contains(lower(text), ' | ') THEN 'TABLE' WHEN contains(lower(text), '!!') THEN 'SHOUT' WHEN contains(lower(text), 'license') THEN 'LICENSE' WHEN contains(lower(text), 'token = ') THEN 'TOKEN' WHEN contains(lower(text), '@') THEN 'MAIL' ELSE 'GENERIC' END AS extractor FROM documents",
    "content_score": "WITH s AS (SELECT doc_id, " + ", ".join(" + ".join(f"CAST(contains(lower(text), '{w} ') AS INTEGER)" for w in ws) + f" AS {n}" for n, ws in (("english", ("the", "of", "and")), ("german", ("der", "die", "und")))) + " FROM documents) SELECT doc_id, english, german, round(greatest(english, german) / CAST(nullif(english + german, 0) AS DOUBLE), 4) AS confidence FROM s",
    "inbox_stats": "SELECT k AS keyword, count(*) AS n, count(DISTINCT source) AS sources FROM documents, (SELECT unnest(['license', 'token', '@']) AS k) WHERE contains(lower(text), k) GROUP BY k ORDER BY n DESC, k LIMIT 20",
    "sample_ids": "SELECT * FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS n FROM documents) WHERE n <= 10",
    "vector_topk": "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS dist FROM embeddings, q) SELECT vec_id, round(dist, 4) AS distance, round(1 / (1 + dist), 4) AS relevance FROM x ORDER BY dist, vec_id LIMIT 5",
    "incremental_dedupe": "SELECT event_type, count(*) AS n, count(*) AS ids FROM events GROUP BY event_type",
}
