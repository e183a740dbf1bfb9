"""Queries over batches. A batch is an order or a customer; its slip amounts are derived from its note amounts."""

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import batches, export, health, pairing, quality
from ..sources.tables import table

NOTE = "CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18, 4))), 2) AS DOUBLE)"
# The same amount as the SQL engine casts it: a line's ten-thousandths are rounded as a double (Spark's cast reads its shortest decimal).
NOTE_OF_LINES = "CAST(round(sum(CAST(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 10000) AS BIGINT) AS DECIMAL(18, 0)) * 0.0001), 2) AS DOUBLE)"
SLIP = "CASE o_orderkey % 5 WHEN 0 THEN note WHEN 1 THEN note WHEN 2 THEN note + 0.01 WHEN 3 THEN note + 7 END"
NOTES_SQL = f"""n AS (SELECT l_orderkey, {NOTE} AS note FROM lineitem GROUP BY l_orderkey),
b0 AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE coalesce(note, 0.0) END AS note FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
b AS (SELECT *, CAST(round({SLIP}, 2) AS DOUBLE) AS slip FROM b0)"""


def order_batches(spark, d):
    """o_orderkey, o_custkey, day, note, slip for every order."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr(NOTE_OF_LINES).alias("note"))
    o = table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    o = o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.coalesce("note", F.lit(0.0))).alias("note"))
    return o.withColumn("slip", F.expr(f"CAST(round({SLIP}, 2) AS DOUBLE)"))


STATUS_SQL = "CASE WHEN note > 0 AND coalesce(slip, 0) > 0 THEN CASE WHEN abs(round(note - slip, 2)) <= 0.01 THEN 'CONCILIADO' ELSE 'DIVERGENTE' END ELSE 'CONFERIR' END"


def reconcile_status(spark, d):
    b = order_batches(spark, d)
    state, diff = batches.status(F.col("note"), F.col("slip"))
    return b.select("o_orderkey", "note", "slip", state.alias("batch_status"), diff.alias("difference"))


def with_problems(spark, d):
    b = order_batches(spark, d)
    state, diff = batches.status(F.col("note"), F.col("slip"))
    b = b.withColumn("status", state).withColumn("diff", diff)
    return quality.exploded(b, [
        quality.problem(F.col("note") <= 0, "VALOR_ZERO", "CRITICA"), quality.problem(F.col("status") == "DIVERGENTE", "DIVERGENCIA", "ALTA"),
        quality.problem(F.col("slip").isNull(), "SEM_BOLETO", "MEDIA"), quality.problem(F.col("status") == "CONCILIADO", "CONFERIDO", "INFO")])


PROBLEM_SQL = f"""WITH {NOTES_SQL}, s AS (SELECT *, {STATUS_SQL} AS status FROM b),
p AS (SELECT *, unnest(list_filter([CASE WHEN note <= 0 THEN {{'kind': 'VALOR_ZERO', 'severity': 3.0}} END, CASE WHEN status = 'DIVERGENTE' THEN {{'kind': 'DIVERGENCIA', 'severity': 2.0}} END,
  CASE WHEN slip IS NULL THEN {{'kind': 'SEM_BOLETO', 'severity': 1.0}} END, CASE WHEN status = 'CONCILIADO' THEN {{'kind': 'CONFERIDO', 'severity': 0.1}} END], lambda x: x IS NOT NULL)) AS p FROM s)"""


def quality_by_type(spark, d):
    return quality.by_kind(with_problems(spark, d), F.col("note").cast("decimal(18,2)")).withColumn("total", F.col("total").cast("double"))


def quality_by_supplier(spark, d):
    p = with_problems(spark, d).where("kind <> 'CONFERIDO'")
    return quality.by_supplier(p, "o_custkey", F.col("note").cast("decimal(18,2)"))


def severity(spark, d):
    worst = with_problems(spark, d).groupBy("o_orderkey").agg(F.max("severity").alias("worst"), F.count("*").alias("n"))
    return worst.select("o_orderkey", quality.bucket(F.col("worst")).alias("severity"), "n")


def top_severe(spark, d):
    return with_problems(spark, d).where("severity >= 2").orderBy(F.desc("note"), "o_orderkey", "kind").limit(10).select("o_orderkey", "kind", "note")


def executive_summary(spark, d):
    b = order_batches(spark, d)
    return quality.summary(b.withColumn("name", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string"))).withColumn("due", F.when(F.col("o_orderkey") % 3 != 0, F.col("day"))), "note", "name", "due")


def line_docs(spark, d):
    kind = F.when(F.col("l_returnflag") == "N", "NFSE").when(F.col("l_returnflag") == "A", "DANFE").otherwise("BOLETO")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("doc_seq"), kind.alias("doc_type"), F.round("l_extendedprice", 2).alias("valor"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey").cast("string")).alias("numero"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_shipdate").cast("date")).alias("vencimento"),
        F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey").cast("string")).alias("numero_pedido"), F.lit(None).cast("string").alias("referencia_nfse"))


LINES_SQL = """d AS (SELECT l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS doc_seq, CASE l_returnflag WHEN 'N' THEN 'NFSE' WHEN 'A' THEN 'DANFE' ELSE 'BOLETO' END AS doc_type, round(l_extendedprice, 2) AS valor,
  CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS numero, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS vencimento, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS numero_pedido,
  l_partkey, l_suppkey FROM lineitem)"""


def first_by_priority(spark, d):
    ld = line_docs(spark, d)
    v = batches.first_by_priority(ld, "valor", ("NFSE", "DANFE", "OUTRO", "BOLETO"), F.col("valor") > 30000, "valor_compra")
    n = batches.first_by_priority(ld, "numero", ("BOLETO", "NFSE"), F.col("numero").isNotNull(), "numero_nota")
    return v.join(n, "batch_id")


PRIORITY_SQL = f"""WITH {LINES_SQL},
v AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN valor > 30000 THEN 0 ELSE 1 END, CASE doc_type WHEN 'NFSE' THEN 1 WHEN 'DANFE' THEN 2 ELSE 4 END, doc_seq) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN numero IS NOT NULL AND doc_type <> 'DANFE' THEN 0 ELSE 1 END, CASE doc_type WHEN 'BOLETO' THEN 1 ELSE 2 END, doc_seq) AS i FROM d)
SELECT v.batch_id, CASE WHEN v.valor > 30000 THEN v.valor END AS valor_compra, CASE WHEN v.valor > 30000 THEN v.doc_type END AS valor_compra_source,
  CASE WHEN n.numero IS NOT NULL AND n.doc_type <> 'DANFE' THEN n.numero END AS numero_nota, CASE WHEN n.numero IS NOT NULL AND n.doc_type <> 'DANFE' THEN n.doc_type END AS numero_nota_source
FROM v JOIN n ON v.batch_id = n.batch_id AND v.i = 1 AND n.i = 1"""


def batch_totals(spark, d):
    t = batches.totals(line_docs(spark, d).withColumn("valor", F.col("valor").cast("decimal(18,2)").cast("double")), ("NFSE", "DANFE", "BOLETO"))
    return t.select("batch_id", "total_documents", *[F.round(c, 2).alias(c) for c in ("total_nfse", "total_danfe", "total_boleto")], "n_nfse", "n_danfe", "n_boleto", (F.col("n_boleto") > 0).alias("has_boleto"))


TOTALS_SQL = f"WITH {LINES_SQL} SELECT batch_id, count(*) AS total_documents, " + ", ".join(f"round(sum(CASE WHEN doc_type = '{k}' THEN valor ELSE 0 END), 2) AS total_{k.lower()}, count(*) FILTER (doc_type = '{k}') AS n_{k.lower()}" for k in ("NFSE", "DANFE", "BOLETO")) + ", count(*) FILTER (doc_type = 'BOLETO') > 0 AS has_boleto FROM d GROUP BY batch_id"


def inherit_first(spark, d):
    return batches.inherit(line_docs(spark, d)).select("batch_id", "doc_seq", "doc_type", "referencia_nfse", "vencimento", "numero_pedido")


INHERIT_SQL = f"""WITH {LINES_SQL}, f AS (SELECT batch_id, arg_min(numero, doc_seq) FILTER (doc_type <> 'BOLETO' AND numero IS NOT NULL) AS n, arg_min(vencimento, doc_seq) FILTER (doc_type = 'BOLETO' AND vencimento IS NOT NULL) AS v,
  arg_min(numero_pedido, doc_seq) FILTER (numero_pedido IS NOT NULL) AS p FROM d GROUP BY batch_id)
SELECT d.batch_id, doc_seq, doc_type, CASE WHEN doc_type = 'BOLETO' THEN n END AS referencia_nfse, CASE WHEN doc_type = 'BOLETO' THEN vencimento ELSE coalesce(vencimento, v) END AS vencimento, coalesce(numero_pedido, p) AS numero_pedido FROM d JOIN f ON d.batch_id = f.batch_id"""


def duplicates(spark, d):
    return batches.duplicates(table(spark, d, "documents"), [F.md5("text").alias("text_md5")], "doc_id")


def duplicate_lines(spark, d):
    return batches.duplicates(table(spark, d, "lineitem"), [F.col("l_suppkey"), F.round("l_extendedprice", 0).cast("bigint").alias("price")], "l_orderkey")


def complement_left(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    main = docs.where("doc_id % 2 = 0").select("doc_id", "source", F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("lang"), "n_chars")
    extra = docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "x_id")
    return batches.complement_near(main, extra, ["source"], "n_chars", 50, "doc_id", "x_id", ["lang"])


COMPLEMENT_SQL = """WITH m AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN lang END AS lang, n_chars FROM documents WHERE doc_id % 2 = 0), x AS (SELECT * FROM documents WHERE doc_id % 2 = 1),
j AS (SELECT m.doc_id, x.doc_id AS x_id, coalesce(m.lang, x.lang) AS lang, row_number() OVER (PARTITION BY m.doc_id ORDER BY x.doc_id NULLS LAST) AS i FROM m LEFT JOIN x ON m.source = x.source AND abs(m.n_chars - x.n_chars) < 50)
SELECT doc_id, x_id, lang FROM j WHERE i = 1"""


def enrich_metadata(spark, d):
    """Dimension look-ups; Spark broadcasts a dimension only where its size allows."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")), "r_name").alias("city"), F.coalesce("r_name", F.lit("?")).alias("region"))


ENRICH_SQL = "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN n_name END, r_name) AS city, coalesce(r_name, '?') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def pair_core(spark, d):
    """One-to-one pairing within a batch (customer) by equal normalised number, amounts compared after."""
    b = order_batches(spark, d)
    note = b.select("o_custkey", "o_orderkey", "note", ids.invoice_number(F.concat(F.lit("2025/"), F.col("o_orderkey").cast("string"))).alias("number"))
    slip = b.where("slip > 0").select(F.col("o_custkey").alias("c"), "slip", ids.invoice_number(F.concat(F.lit("000"), F.col("o_orderkey").cast("string"))).alias("slip_number"))
    p = note.join(slip, (F.col("o_custkey") == F.col("c")) & (F.col("number") == F.col("slip_number")), "left")
    state, diff = batches.status(F.col("note"), F.col("slip"))
    return p.select("o_custkey", "o_orderkey", "slip_number", state.alias("pair_status"), diff.alias("difference"))


def _documents(batches_, *kinds):
    """The documents of each batch in one pass over batches: of every (condition, columns) in kinds where it holds."""
    docs = F.array(*(F.when(where, F.struct(*columns)) for where, columns in kinds))
    return batches_.select(F.inline(F.array_compact(docs)))


def pair_exact(spark, d):
    k = F.col("o_orderkey")

    def document(seq, kind, mark, number, value, line):
        values = {"batch_id": F.col("o_custkey").cast("string"), "doc_seq": k * 2 + seq, "doc_type": F.lit(kind), "arquivo_origem": F.concat(F.lit(mark), k, F.lit(".pdf")), "numero": F.concat(F.lit(number), k), "valor": value, "linha_digitavel": line}
        return [v.alias(c) for c, v in values.items()]

    return pairing.pair_documents(_documents(order_batches(spark, d), (F.lit(True), document(0, "NFSE", "nf_", "2025/", F.col("note"), F.lit(None).cast("string"))),
                                             (F.col("slip") > 0, document(1, "BOLETO", "bol_", "2025.", F.col("slip"), F.lpad(k.cast("string"), 47, "3")))))


def pair_fields(spark, d):
    """Pairs of documents that lack a number or a field: numbers from file names, and each pair's first field that is there."""
    b = order_batches(spark, d).where("note > 0 AND slip > 0")
    k = F.col("o_orderkey")
    text, day, none = k.cast("string"), lambda x: F.lit(x).cast("date"), F.lit(None).cast("string")
    file = lambda mark, end=".pdf": F.concat(F.lit(mark), text, F.lit(end))

    def document(seq, kind, name, value, number, supplier, cnpj, due, reference):
        values = {"batch_id": text, "doc_seq": F.lit(seq), "doc_type": F.lit(kind), "arquivo_origem": name, "valor": value, "linha_digitavel": none, "numero": number, "fornecedor_nome": supplier, "cnpj": cnpj, "vencimento": due, "referencia_nfse": reference}
        return [v.alias(c) for c, v in values.items()]

    unnumbered = F.when(k % 3 == 0, F.lit(""))
    docs = _documents(b, (F.lit(True), document(1, "NFSE", file("NF "), F.col("note"), unnumbered, F.when(k % 2 == 0, F.lit("ALFA LTDA | CNPJ - CNPJ")), none, F.when(k % 5 == 0, day("2001-01-02")), none)),
                      (k % 7 == 0, document(2, "NFSE", file("nfse_", ".xml"), F.col("note"), unnumbered, F.lit("BETA SA"), F.lit("C2"), day("2001-03-04"), none)),
                      (F.lit(True), document(3, "BOLETO", F.when(k % 4 == 0, F.lit("bol.pdf")).otherwise(file("BOLETO NF ")), F.col("slip"), F.when(k % 4 != 0, F.lit("999")), F.lit("GAMA"), F.lit("C3"), day("2001-05-06"), text)))
    return pairing.pair_documents(docs).select("batch_id", "pair_id", "note_number", "pair_status", F.size("note_docs").alias("n_notes"), F.size("slip_docs").alias("n_slips"), "fornecedor_nome", "cnpj", "vencimento")


def pair_kinds(spark, d):
    """Documents of each kind in the pairs of a batch."""
    b = order_batches(spark, d)
    docs = b.select(F.col("o_custkey").cast("string").alias("batch_id"), F.element_at(F.array(*map(F.lit, ("NFSE", "DANFE", "OUTRO"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("doc_type"), F.concat(F.lit("nf_"), "o_orderkey").alias("arquivo_origem"))
    slips = b.where("slip > 0").select(F.col("o_custkey").cast("string").alias("batch_id"), F.lit("BOLETO").alias("doc_type"), F.concat(F.lit("bol_"), "o_orderkey").alias("arquivo_origem"))
    pairs = b.select(F.col("o_custkey").cast("string").alias("batch_id"), F.concat("o_custkey", F.lit("_"), "o_orderkey").alias("pair_id"), F.array(F.concat(F.lit("nf_"), "o_orderkey")).alias("note_docs"), F.when(F.col("slip") > 0, F.array(F.concat(F.lit("bol_"), "o_orderkey"))).otherwise(F.array().cast("array<string>")).alias("slip_docs"))
    return health.pair_counts(pairs, docs.unionByName(slips))


# The fold over documents in order, as recursion over each batch's documents: the state is the list of groups so far.
_FOLD = """
{f}0 AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY seq) AS t, num, val, file FROM {src}),
{f}1 AS (SELECT batch, CAST(0 AS BIGINT) AS t, CAST([] AS STRUCT(num VARCHAR, val DOUBLE, docs VARCHAR[])[]) AS g FROM every
  UNION ALL SELECT s.batch, n.t, CASE WHEN s.p IS NULL OR s.p = 0 THEN list_append(s.g, {{'num': n.num, 'val': n.val, 'docs': [n.file]}})
    ELSE list_concat(s.g[1:s.p - 1], [{{'num': CASE WHEN length(n.num) < length(s.g[s.p].num) THEN n.num ELSE s.g[s.p].num END, 'val': s.g[s.p].val{add}, 'docs': list_append(s.g[s.p].docs, n.file)}}], s.g[s.p + 1:]) END
  FROM (SELECT a.batch, a.t, a.g, list_position(list_transform(a.g, lambda x: (x.num = m.num OR ends_with(x.num, m.num) OR ends_with(m.num, x.num)){near}), true) AS p FROM {f}1 a JOIN {f}0 m ON m.batch = a.batch AND m.t = a.t + 1) s
  JOIN {f}0 n ON n.batch = s.batch AND n.t = s.t + 1),
{f} AS (SELECT batch, arg_max(g, t) AS g FROM {f}1 GROUP BY batch)"""
# A slip's amount, unless its line is one of the group's; lines are the numbers filled up with 3.
_ADD = " + CASE WHEN list_contains(list_transform(s.g[s.p].docs, lambda f: lpad(regexp_extract(f, '[0-9]+'), 47, '3')), lpad(n.num, 47, '3')) THEN 0 ELSE n.val END"
PAIR_SQL = f"""WITH RECURSIVE {NOTES_SQL},
docs AS (SELECT CAST(o_custkey AS VARCHAR) AS batch, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS num, note, slip, 'nf_' || o_orderkey || '.pdf' AS nf, 'bol_' || o_orderkey || '.pdf' AS bol FROM b),
every AS (SELECT batch, count(*) AS notes, count_if(slip > 0) AS slips, max(note) AS top, arg_min(num, seq) AS num, arg_min(nf, seq) AS nf, max(CASE WHEN slip > 0 THEN slip END) AS slip, max(CASE WHEN slip > 0 THEN bol END) AS bol FROM docs GROUP BY batch),
src_n AS (SELECT batch, seq, num, note AS val, nf AS file FROM docs WHERE note > 0), src_s AS (SELECT batch, seq, num, slip AS val, bol AS file FROM docs WHERE slip > 0),
{_FOLD.format(f="ns", src="src_n", add="", near=" OR abs(x.val - m.val) <= 0.01")},
{_FOLD.format(f="ss", src="src_s", add=_ADD, near="")},
st AS (SELECT ns.batch, ns.g AS n, ss.g AS s FROM ns JOIN ss USING (batch)),
mt AS (SELECT batch, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS hit FROM st
  UNION ALL SELECT x.batch, x.i + 1, CASE WHEN x.j IS NULL THEN x.used ELSE list_append(x.used, x.j) END, list_append(x.hit, coalesce(x.j, 0)) FROM (
    SELECT m.batch, m.i, m.used, m.hit, list_extract(list_filter(range(1, len(st.s) + 1), lambda j: NOT list_contains(m.used, j) AND (st.s[j].num = st.n[m.i + 1].num OR ends_with(st.s[j].num, st.n[m.i + 1].num) OR ends_with(st.n[m.i + 1].num, st.s[j].num) OR abs(st.n[m.i + 1].val - st.s[j].val) <= 0.01)), 1) AS j
    FROM mt m JOIN st USING (batch) WHERE m.i < len(st.n)) x),
fin AS (SELECT batch, arg_max(used, i) AS used, arg_max(hit, i) AS hit FROM mt GROUP BY batch),
f AS (SELECT st.batch, n, s, used, hit, list_filter(range(1, len(n) + 1), lambda i: hit[i] = 0) AS alone, list_filter(range(1, len(s) + 1), lambda j: NOT list_contains(used, j)) AS free, e.notes = 1 AND e.slips = 1 AND e.top = 0 AS forced FROM st JOIN fin USING (batch) JOIN every e USING (batch)),
a AS (SELECT *, CASE WHEN len(alone) > 1 THEN list_reduce(list_transform(alone, lambda i: n[i].val), lambda x, y: x + y) END AS total FROM f),
c AS (SELECT *, coalesce(len(free) = 1 AND abs(total - s[free[1]].val) <= 0.01, false) AS whole FROM a WHERE NOT forced),
p AS (SELECT batch, batch || CASE WHEN len(n) > 1 THEN '_' || n[i].num ELSE '' END AS pair_id, n[i].num AS note_number, n[i].val AS nv, CASE WHEN hit[i] > 0 THEN s[hit[i]].val ELSE 0 END AS sv, n[i].docs AS note_docs, CASE WHEN hit[i] > 0 THEN s[hit[i]].docs ELSE [] END AS slip_docs, NULL AS status FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM c)
  UNION ALL SELECT batch, batch || '_agregado', NULL, total, s[free[1]].val, flatten(list_transform(alone, lambda i: n[i].docs)), s[free[1]].docs, NULL FROM c WHERE whole
  UNION ALL SELECT batch, batch || '_bol' || k, s[free[k]].num, 0, s[free[k]].val, [], s[free[k]].docs, NULL FROM (SELECT *, unnest(range(1, len(free) + 1)) AS k FROM c WHERE NOT whole)
  UNION ALL SELECT batch, batch, NULL, 0, 0, [], [], NULL FROM c WHERE len(n) = 0 AND len(s) = 0
  UNION ALL SELECT e.batch, e.batch, e.num, 0, e.slip, [e.nf], [e.bol], 'PAREADO_FORCADO' FROM every e JOIN a USING (batch) WHERE a.forced)
SELECT batch AS batch_id, pair_id, note_number, nv AS note_value, sv AS slip_value, round(nv - sv, 2) AS difference, coalesce(status, CASE WHEN nv > 0 AND sv > 0 THEN CASE WHEN abs(round(nv - sv, 2)) <= 0.01 THEN 'CONCILIADO' ELSE 'DIVERGENTE' END ELSE 'CONFERIR' END) AS pair_status, note_docs, slip_docs FROM p"""
PAIR_FIELDS_SQL = f"""WITH {NOTES_SQL}, x AS (SELECT *, o_orderkey AS k, o_orderkey % 7 = 0 AS two FROM b WHERE note > 0 AND slip > 0)
SELECT CAST(k AS VARCHAR) AS batch_id, CAST(k AS VARCHAR) AS pair_id, CAST(k AS VARCHAR) AS note_number, CASE WHEN abs(round(note - slip, 2)) <= 0.01 THEN 'CONCILIADO' ELSE 'DIVERGENTE' END AS pair_status, CASE WHEN two THEN 2 ELSE 1 END AS n_notes, 1 AS n_slips,
  CASE WHEN k % 2 = 0 THEN 'ALFA LTDA' WHEN two THEN 'BETA SA' ELSE 'GAMA' END AS fornecedor_nome, CASE WHEN two THEN 'C2' ELSE 'C3' END AS cnpj, CASE WHEN k % 5 = 0 THEN DATE '2001-01-02' WHEN two THEN DATE '2001-03-04' ELSE DATE '2001-05-06' END AS vencimento FROM x"""
PAIR_KINDS_SQL = f"""WITH {NOTES_SQL}, x AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, ['NFSE', 'DANFE', 'OUTRO'][o_orderkey % 3 + 1] AS kind FROM b)
SELECT CAST(o_custkey AS VARCHAR) AS batch_id, o_custkey || '_' || o_orderkey AS pair_id, CAST(kind = 'DANFE' AS BIGINT) AS danfes, CAST(kind = 'NFSE' AS BIGINT) AS nfses, CAST(kind = 'OUTRO' AS BIGINT) AS outros, CAST(coalesce(slip, 0) > 0 AS BIGINT) AS boletos, CASE WHEN slip > 0 THEN 2 ELSE 1 END AS total_documents FROM x"""


def paf_projection(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(export.br_day(day).alias("DATA"), F.lit("").alias("SETOR"), F.lit("").alias("EMPRESA"), F.concat(F.lit("Cliente "), "o_custkey").alias("FORNECEDOR"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey").cast("string")).otherwise("").alias("NF"),
        export.br_day(F.when(F.col("o_orderkey") % 6 != 0, day)).alias("EMISSAO"), export.decimal_comma(F.col("o_totalprice")).alias("VALOR"), export.clean_cell(F.concat("o_orderpriority", F.lit(";\nx"))).alias("OBSERVACOES"), F.lit("PENDENTE").alias("LANC_SISTEMA"), F.when(F.col("o_orderstatus") == "F", "NF").otherwise("FT").alias("TP_DOC"))


PAF_SQL = r"""SELECT strftime(o_orderdate, '%d/%m/%Y') AS DATA, '' AS SETOR, '' AS EMPRESA, 'Cliente ' || o_custkey AS FORNECEDOR, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS NF,
  CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '' END AS EMISSAO, replace(printf('%.2f', o_totalprice), '.', ',') AS VALOR, o_orderpriority || ' x' AS OBSERVACOES, 'PENDENTE' AS LANC_SISTEMA, CASE WHEN o_orderstatus = 'F' THEN 'NF' ELSE 'FT' END AS TP_DOC FROM orders"""


def tab_split(spark, d):
    """Union by name of two layouts, one with fewer columns."""
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("anexos").alias("tab"), F.round("o_totalprice", 2).alias("VALOR"))
    b = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("sem_anexos").alias("tab"))
    return export.by_priority(a.unionByName(b, allowMissingColumns=True), ["tab", "o_orderkey"])


def merge_partial(spark, d):
    o = table(spark, d, "orders")
    current = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("current").alias("origin"))
    old = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("stored").alias("origin"))
    return batches.merged(current, old.unionAll(old), "o_orderkey")


def timeout_retry(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return batches.retry(o.withColumnRenamed("o_custkey", "batch"), o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("batch")).distinct(), "batch")


def repeated_slip_line(spark, d):
    """Second and later occurrence of the same digits in a batch."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.substring(ids.digits(F.concat(F.lit("n."), F.col("l_partkey").cast("string"))), 1, 2).alias("line"))
    return batches.repeated_lines(li, "l_suppkey", "line", ["l_orderkey", "l_linenumber"]).drop("line")


def mail_enrichment(spark, d):
    """Orders as documents, customers as their mails; every second mail has a subject of its own."""
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("batch_id"), F.when(k % 3 == 0, F.lit("X")).when(k % 3 == 1, F.lit("")).alias("fornecedor_nome"), F.when(k % 2 == 0, F.lit("1")).alias("cnpj"), F.when(k % 5 == 0, F.lit("P")).alias("numero_pedido"), F.lit("velho").alias("email_subject"))
    m = table(spark, d, "customer")
    mails = m.select(F.col("c_custkey").alias("batch_id"), F.col("c_name").alias("mail_fornecedor"), F.col("c_custkey").cast("string").alias("mail_cnpj"), F.when(F.col("c_custkey") % 2 == 0, F.lit("M")).alias("mail_pedido"))
    subjects = m.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("batch_id"), F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.lit("novo")).alias("subject"))
    return batches.with_subjects(batches.enriched(docs, mails), subjects)


QUERIES = {f.__name__: f for f in (quality_by_type, quality_by_supplier, severity, top_severe, executive_summary, reconcile_status, first_by_priority, batch_totals, inherit_first, duplicates, duplicate_lines, complement_left, enrich_metadata, pair_core, pair_exact, pair_fields, pair_kinds, paf_projection, tab_split, merge_partial, timeout_retry, repeated_slip_line, mail_enrichment)}
SQL = {
    "quality_by_type": PROBLEM_SQL + " SELECT p.kind AS kind, CAST(max(p.severity) AS DOUBLE) AS max_severity, count(*) AS n, CAST(sum(CAST(note AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM p GROUP BY p.kind ORDER BY 2 DESC, 3 DESC, 1",
    "quality_by_supplier": PROBLEM_SQL + " SELECT o_custkey, count(*) AS n, CAST(sum(CAST(note AS DECIMAL(18, 2))) AS DOUBLE) AS total, array_to_string(list_sort(list_distinct(list(p.kind))), ',') AS kinds FROM p WHERE p.kind <> 'CONFERIDO' GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10",
    "severity": PROBLEM_SQL + " SELECT o_orderkey, CASE WHEN max(p.severity) >= 3 THEN 'CRITICA' WHEN max(p.severity) >= 2 THEN 'ALTA' WHEN max(p.severity) >= 1 THEN 'MEDIA' ELSE 'BAIXA' END AS severity, count(*) AS n FROM p GROUP BY o_orderkey",
    "top_severe": PROBLEM_SQL + " SELECT o_orderkey, p.kind AS kind, note FROM p WHERE p.severity >= 2 ORDER BY note DESC, o_orderkey, kind LIMIT 10",
    "executive_summary": f"WITH {NOTES_SQL} SELECT count(*) AS total, count(*) FILTER (note > 0) AS with_value, count(*) FILTER (o_custkey % 7 <> 0) AS with_name, count(*) FILTER (o_orderkey % 3 <> 0) AS with_due, round(100.0 * count(*) FILTER (note > 0) / count(*), 2) AS pct_with_value, round(100.0 * count(*) FILTER (o_custkey % 7 <> 0) / count(*), 2) AS pct_with_name, round(100.0 * count(*) FILTER (o_orderkey % 3 <> 0) / count(*), 2) AS pct_with_due FROM b",
    "reconcile_status": f"WITH {NOTES_SQL} SELECT o_orderkey, note, slip, {STATUS_SQL} AS batch_status, round(note - coalesce(slip, 0), 2) AS difference FROM b",
    "first_by_priority": PRIORITY_SQL, "batch_totals": TOTALS_SQL, "inherit_first": INHERIT_SQL,
    "duplicates": "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_lines": "SELECT l_suppkey, CAST(round(l_extendedprice, 0) AS BIGINT) AS price, count(*) AS n, min(l_orderkey) AS first_id FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "complement_left": COMPLEMENT_SQL, "enrich_metadata": ENRICH_SQL,
    "pair_exact": PAIR_SQL, "pair_fields": PAIR_FIELDS_SQL, "pair_kinds": PAIR_KINDS_SQL,
    "pair_core": f"WITH {NOTES_SQL} SELECT o_custkey, o_orderkey, CASE WHEN slip > 0 THEN CAST(o_orderkey AS VARCHAR) END AS slip_number, CASE WHEN note > 0 AND slip > 0 THEN CASE WHEN abs(round(note - slip, 2)) <= 0.01 THEN 'CONCILIADO' ELSE 'DIVERGENTE' END ELSE 'CONFERIR' END AS pair_status, round(note - CASE WHEN slip > 0 THEN slip ELSE 0 END, 2) AS difference FROM b",
    "paf_projection": PAF_SQL,
    "tab_split": "SELECT CASE WHEN o_orderstatus <> 'P' THEN 'anexos' ELSE 'sem_anexos' END AS tab, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS VALOR FROM orders",
    "merge_partial": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'current' ELSE 'stored' END AS origin FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0",
    "timeout_retry": "SELECT DISTINCT o_custkey AS batch FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)",
    "repeated_slip_line": "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, substr(CAST(l_partkey AS VARCHAR), 1, 2) ORDER BY l_orderkey, l_linenumber) > 1 AS repeated FROM lineitem",
    "mail_enrichment": "SELECT o_orderkey, o_custkey AS batch_id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE c_name END AS fornecedor_nome, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE CAST(c_custkey AS VARCHAR) END AS cnpj, CASE WHEN o_orderkey % 5 = 0 THEN 'P' WHEN c_custkey % 2 = 0 THEN 'M' END AS numero_pedido, CASE WHEN c_custkey % 4 = 2 THEN 'novo' ELSE 'velho' END AS email_subject FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
}
