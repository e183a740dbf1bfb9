"""Which mail is billing mail: one CASE over boolean columns, nothing evaluated twice."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, masked, matches_any, occurrences


def has_link(body: Column) -> Column:
    return F.coalesce(body.rlike(r"(?iu)https?://[^\s]*(?:" + "|".join(fixed.LINK_PARTS) + ")"), F.lit(False))


def has_code(body: Column) -> Column:
    return matches_any(body, fixed.CODE_PATTERNS)


def has_attachment(names: Column) -> Column:
    return F.coalesce(F.exists(names, lambda n: n.rlike("(?i)" + fixed.VALID_ATTACHMENT)), F.lit(False))


def ignored_attachment(name: Column) -> Column:
    low = F.lower(F.trim(name))
    ending = r"(" + "|".join(e.replace(".", r"\.") for e in fixed.IGNORED_EXTENSIONS) + ")$"
    return name.isNull() | (low == "") | low.rlike(ending) | low.rlike("|".join(fixed.IGNORED_NAMES))


def decision(subject: Column, sender: Column, attachment: Column, link: Column, code: Column, black: tuple[str, ...] = (), white: tuple[str, ...] = (), black_senders: tuple[str, ...] = (), white_senders: tuple[str, ...] = ()) -> Column:
    """PROCESS, or why not. Patterns of the user's own are asked after the fixed ones."""
    return (
        F.when(attachment, F.lit("PROCESS"))
        .when(matches_any(sender, (*fixed.SENDER_BLACK, *black_senders)), F.lit("SKIP_SENDER_BLACKLIST"))
        .when(matches_any(subject, (*fixed.SUBJECT_BLACK, *black)), F.lit("SKIP_BLACKLIST"))
        .when(~(link | code), F.lit("SKIP_NO_CONTENT"))
        .when(matches_any(subject, (*fixed.SUBJECT_WHITE, *white)) | matches_any(sender, (*fixed.SENDER_WHITE, *white_senders)), F.lit("PROCESS"))
        .otherwise(F.lit("SKIP_NO_SUBJECT_MATCH"))
    )


def content_type(attachment: Column, link: Column, code: Column) -> Column:
    return (
        F.when(attachment, F.lit("COM_ANEXO")).when(link & code, F.lit("LINK_COM_CODIGO")).when(link, F.lit("LINK_DOWNLOAD"))
        .when(code, F.lit("APENAS_CODIGO")).otherwise(F.lit("IRRELEVANTE"))
    )


def split_batch(mails, decided: str = "decision"):
    """Mail to process, the rest, and the number of each decision."""
    return mails.where(F.col(decided) == "PROCESS"), mails.where(F.col(decided) != "PROCESS"), mails.groupBy(decided).agg(F.count("*").alias("n"))


def whitelist_matches(subject: Column) -> Column:
    """Every white pattern's hit, as text."""
    return F.array_compact(F.array(*[F.nullif(F.regexp_extract(subject, f"(?iu){p}", 0), F.lit("")) for p in fixed.SUBJECT_WHITE]))


def keyword_counts(mails: DataFrame, text: str, sender: str, keywords: tuple[str, ...], n: int = 20) -> DataFrame:
    """keyword, n, sources: in how many mails and from how many senders each keyword comes, the most frequent first."""
    found = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(F.col(text)), k))
    words = mails.select(sender, F.explode(found).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("n"), F.count_distinct(sender).alias("sources")).orderBy(F.desc("n"), "keyword").limit(n)


def samples(mails: DataFrame, kind: str, order: str, n: int = 10) -> DataFrame:
    """The first mails of each kind, numbered."""
    from pyspark.sql import Window as W

    return mails.withColumn("n", F.row_number().over(W.partitionBy(kind).orderBy(order))).where(F.col("n") <= n)


#: What looks like a number in a mail and is none: links, tags, names of dated images.
NO_NUMBER = (r'https?://[^\s<>"]+', r"<[^>]+>", r"(?i)\b\d{4}-\d{2}-\d{2}[^/\s]*\.(?:png|jpg|jpeg|gif|bmp)\b")


def number_in_mail(subject: Column, body: Column) -> Column:
    """struct<number, start>: a note's or bill's number in a mail's subject, else its body, and where in that text it stands. A pattern whose first hit is a year
    alone gives none."""
    def of(text: Column) -> Column:
        def hit(clean: Column, pattern: str) -> Column:
            def told(o: Column) -> Column:
                number = F.regexp_extract(o["raw"], f"(?U){pattern}", 1)
                return F.when(~number.rlike(r"^20\d\d$"), F.struct(number.alias("number"), (o["end"] - F.length(number)).alias("start")))

            return let(F.get(occurrences(clean, f"(?U){pattern}"), F.lit(0)), lambda o: F.when(o.isNotNull(), told(o)))

        return let(masked(F.coalesce(text, F.lit("")), *NO_NUMBER), lambda clean: F.coalesce(*[hit(clean, p) for p in fixed.MAIL_NUMBERS]))

    return F.coalesce(of(subject), of(body))
