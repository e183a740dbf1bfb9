"""Own companies in texts and names. The dimension (cnpj, name, city, pos) is joined by equal keys: numbers, words and
beginnings of domains, never text by text; `pos` is its order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.fixed import COMMON_NAME_WORDS, MAIL_FOR, MAIL_LINKS, MAIL_PROVIDERS, MAIL_SECRET, MAIL_STOPWORDS
from ..functions.text import let, occurrences

#: A tax number, dotted with or without blanks, or 14 digits; no digit beside it.
ANY_CNPJ = r"(?<!\d)(?:\d{2}\s*\.\s*\d{3}\s*\.\s*\d{3}\s*/\s*\d{4}\s*-\s*\d{2}|\d{14})(?!\d)"
#: Domains of addresses and bare ones.
MAIL_DOMAIN = r"\b[a-z0-9._%+\-]+@([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)\b"
BARE_DOMAIN = r"\b(?:[a-z0-9\-]+\.)+[a-z]{2,}(?:\.[a-z]{2,})?\b"
NEAR = 250


def cnpjs_with_offsets(text: Column) -> Column:
    """array<struct<raw, start, end>> of the tax numbers of a text."""
    return occurrences(text, ANY_CNPJ)


def domains(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(MAIL_DOMAIN), F.lit(1)), F.regexp_extract_all(low, F.lit(f"({BARE_DOMAIN})"), F.lit(1))))


def with_codes(companies: DataFrame) -> DataFrame:
    return companies.select("cnpj", "name", "pos", ids.company_code(F.col("name")).alias("code"))


def by_number(docs: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """Per document, the company whose number stands in the best surroundings, the earliest of equals."""
    def around(o: Column) -> Column:
        begin = F.greatest(o["start"] - NEAR, F.lit(0))
        return F.struct(ids.digits(o["raw"]).alias("cnpj"), o["start"].alias("start"), F.upper(F.substring(F.col(text), begin + 1, o["end"] + NEAR - begin)).alias("near"))

    # Only the surroundings go through the explode, not the text.
    o = docs.select(key, F.inline(F.transform(cnpjs_with_offsets(F.col(text)), around)))
    score = F.lit(10)
    for pattern, more in ((r"(?U)\b(DADOS\s+DO\s+PAGADOR|PAGADOR|SACADO)\b", 6), (r"(?U)\b(TOMADOR|DESTINAT[ÁA]RIO|CLIENTE|CONTRATANTE)\b", 4), (r"(?U)\bCNPJ\b", 1)):
        score = score + F.col("near").rlike(pattern).cast("int") * more
    hit = o.withColumn("score", score).join(with_codes(companies), "cnpj")
    best = F.max_by(F.struct("code", "cnpj", F.lit("cnpj").alias("method"), "score"), F.struct("score", -F.col("start")))
    return hit.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def by_code(docs: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """Per document, the first company of the dimension whose code is a word of the text."""
    words = docs.select(key, F.explode(F.array_distinct(F.split(F.upper(F.col(text)), r"(?U)\W+"))).alias("code"))
    hit = words.join(with_codes(companies), "code")
    best = F.min_by(F.struct("code", "cnpj", F.lit("nome").alias("method"), F.lit(5).alias("score")), "pos")
    return hit.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def by_domain(docs: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """Per document, the company whose code begins a domain or is a word of one; longer codes first, up to three letters."""
    d = docs.select(key, F.explode(F.transform(domains(F.col(text)), F.upper)).alias("d"))
    main = F.substring_index("d", ".", 1)
    starts = F.transform(F.sequence(F.lit(2), F.lit(10)), lambda n: F.left(main, n))
    d = d.select(key, F.explode(F.array_distinct(F.concat(starts, F.split("d", "[^A-Z0-9]+")))).alias("code")).distinct()
    hit = d.join(with_codes(companies).where(F.length("code").between(2, 10)), "code").withColumn("score", 7 + F.least(F.lit(3), F.length("code")))
    best = F.max_by(F.struct("code", "cnpj", F.lit("domain").alias("method"), "score"), F.struct("score", -F.col("pos")))
    return hit.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def company_of(docs: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """key, code, cnpj, method, score: by number, else by code, else by domain; nulls where no company is named."""
    at = docs.select(key)
    for i, find in enumerate((by_number, by_code, by_domain)):
        got = find(docs, companies, key, text)
        at = at.join(got.select(key, F.struct("code", "cnpj", "method", "score").alias(f"_{i}")), key, "left")
    return at.withColumn("m", F.coalesce("_0", "_1", "_2")).select(key, "m.code", "m.cnpj", "m.method", "m.score")


# ---- the company that a mail is for

def mail_words(text: Column, domains: Sequence[str] = ()) -> Column:
    """array<struct<token, at, safe, secret>>: the words of a mail without links, providers' domains, styles and scripts, in upper case, and
    the tax numbers in it (digits). safe: after a label of the receiver on its line; secret: after one of a password."""
    clean = text
    for p in (*MAIL_LINKS, *[r"[\w.%+-]*@" + d.replace(".", r"\.") + r"|https?://\S*" + d.replace(".", r"\.") + r"\S*|\b" + d.replace(".", r"\.") + r"\b" for d in (*domains, *MAIL_PROVIDERS)], r"(?s)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>"):
        clean = F.regexp_replace(clean, f"(?i){p}", " ")

    def words(part: Column) -> Column:
        return F.array_distinct(F.filter(F.split(part, r"(?U)[^\w/]+"), lambda w: ~w.rlike(r"^\d{14}$|^$")))

    def line(row: Column) -> Column:
        safe = F.concat(*[words(F.regexp_extract(row, f"(?U){p}", 0)) for p in MAIL_FOR])
        secret = words(F.regexp_extract(row, f"(?U){MAIL_SECRET}", 0))
        return let(F.struct(safe.alias("safe"), secret.alias("secret")), lambda of: F.transform(words(row), lambda w: F.struct(w.alias("token"), F.lit(0).alias("at"), F.array_contains(of["safe"], w).alias("safe"), F.array_contains(of["secret"], w).alias("secret"))))

    def tokens(t: Column) -> Column:
        numbers = F.transform(cnpjs_with_offsets(t), lambda o: F.struct(ids.digits(o["raw"]).alias("token"), o["start"].alias("at"), F.lit(False).alias("safe"), F.lit(False).alias("secret")))
        return F.concat(numbers, F.flatten(F.transform(F.split(F.upper(t), "\n"), line)))

    return let(clean, tokens)


def mail_index(companies: DataFrame) -> DataFrame:
    """token, how, code, pos: by what a company is found: its number, its code, the first two telling words of its name."""
    c = with_codes(companies)
    telling = F.slice(F.filter(F.regexp_extract_all(F.upper("name"), F.lit(r"\b([A-Z]{4,})\b"), F.lit(1)), lambda w: ~w.isin(*MAIL_STOPWORDS)), 1, 2)
    numbers = c.select(F.col("cnpj").alias("token"), F.lit("cnpj").alias("how"), "code", "pos")
    codes = c.where((F.length("code") >= 3) & ~F.col("code").isin(*MAIL_STOPWORDS)).select(F.upper("code").alias("token"), F.lit("nome_exato").alias("how"), "code", "pos")
    names = c.select(F.explode(F.array_distinct(telling)).alias("token"), F.lit("nome_parcial").alias("how"), "code", "pos")
    return numbers.unionByName(codes).unionByName(names)


def company_in_mail(mails: DataFrame, companies: DataFrame, key: str, text: str, domains: Sequence[str] = ()) -> DataFrame:
    """key, code, method of every mail: by the first own number in it; else by a code after a receiver's label (the dimension's first); else by
    the only code that stands in no password's line; else by the only company one of whose telling words occurs; else nulls.

    One explode of tokens and one join with the dimension's index; what doesn't name a company is gone after it."""
    words = mails.select(key, F.inline(mail_words(F.coalesce(F.col(text), F.lit("")), domains)))
    hit = words.join(mail_index(companies), "token").groupBy(key, "how", "code").agg(F.min("pos").alias("pos"), F.min("at").alias("at"), F.bool_or("safe").alias("safe"), F.bool_or("secret").alias("secret"))
    number, exact, part = (F.col("how") == h for h in ("cnpj", "nome_exato", "nome_parcial"))
    plain = exact & ~F.col("safe") & ~F.col("secret")
    def only(which: Column, value: str) -> Column:
        return F.when(which, F.col(value))

    best = hit.groupBy(key).agg(
        F.min_by(only(number, "code"), only(number, "at")).alias("_n"), F.min_by(only(exact & F.col("safe"), "code"), only(exact & F.col("safe"), "pos")).alias("_s"),
        F.count_if(plain).alias("_plain"), F.min(only(plain, "code")).alias("_e"), F.count_if(part).alias("_parts"), F.min(only(part, "code")).alias("_p"))
    named, partial = F.when(F.col("_plain") == 1, F.col("_e")), F.when(F.col("_parts") == 1, F.col("_p"))
    code, sure = F.coalesce("_n", "_s", named, partial), F.coalesce(F.col("_s"), named)
    method = F.when(F.col("_n").isNotNull(), "cnpj").when(sure.isNotNull(), "nome_exato").when(partial.isNotNull(), "nome_parcial")
    return mails.select(key).join(best, key, "left").select(key, code.alias("code"), method.alias("method"))


def own_name(name: Column, codes: Sequence[str]) -> Column:
    """Whether a name has an own company's code as a word: 2 to 6 letters or digits, no common word. The codes are those
    of the dimension, a list of own companies."""
    short = [c for c in codes if 2 <= len(c) <= 6 and c not in COMMON_NAME_WORDS]
    return F.coalesce(F.upper(name).rlike(r"(?U)\b(?:" + "|".join(short) + r")\b"), F.lit(False)) if short else F.lit(False)


def cnpj_of(company: Column, known: Sequence[tuple[str, str, str]]) -> Column:
    """Number of the first own company (cnpj, name, city) whose name or city holds the given word; null for none or empty."""
    word = F.nullif(F.upper(company), F.lit(""))
    return F.coalesce(*[F.when(F.contains(F.lit(f"{name}\n{city}".upper()), word), F.lit(cnpj)) for cnpj, name, city in known], F.lit(None).cast("string"))


def corrected(docs: DataFrame) -> DataFrame:
    """docs (empresa, name_ours, cnpj_ours, foreign, fornecedor_nome, cnpj) with supplier and number put right. Only where an
    own company was found: a supplier that is an own company goes if there is no number or an own one; an own number gives
    way to the first foreign one of the text. cnpj is the slip's beneficiary or the note's provider."""
    found, ours = F.col("empresa").isNotNull(), F.coalesce("cnpj_ours", F.lit(False)) & F.col("cnpj").isNotNull()
    clear = found & F.coalesce("name_ours", F.lit(False)) & (F.col("cnpj").isNull() | ours)
    return docs.withColumns({"fornecedor_nome": F.when(~clear, F.col("fornecedor_nome")), "cnpj": F.when(found & ours & F.col("foreign").isNotNull(), ids.format_cnpj(F.col("foreign"))).otherwise(F.col("cnpj"))})


def supplier_guess(current: Column, inferred: Column, generic: Column, foreign: Column, text: Column) -> Column:
    """struct<corrected, suggested, method, confidence>: the inferred name, else the first foreign number, else a line of the
    text that looks like a company. generic: whether the inferred name says nothing."""
    up = F.upper(F.coalesce(text, F.lit("")))
    line = F.get(F.filter(F.transform(F.split(up, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(r"LTDA|S/A|EIRELI") & F.length(x).between(11, 99)), F.lit(0))

    def told(name: Column, method: str, confidence: float) -> Column:
        return F.struct(F.lit(method != "no_match").alias("corrected"), name.alias("suggested"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    named = inferred.isNotNull() & ~inferred.eqNullSafe(current) & ~F.coalesce(generic, F.lit(False))
    return (F.when(named, told(inferred, "infer", 0.8)).when(foreign.isNotNull(), told(F.concat(F.lit("CNPJ: "), ids.format_cnpj(foreign)), "cnpj_only", 0.6))
            .when(line.isNotNull(), told(line, "pattern_match", 0.4)).otherwise(told(F.lit(None).cast("string"), "no_match", 0.0)))
