"""Mail as a table: headers decoded, senders, bodies, dates; what an inbox adapter hands over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dates import header_date
from ..functions.fixed import HTML_MARK


@F.pandas_udf(StringType())
def decoded_header(text: pd.Series) -> pd.Series:
    """RFC 2047 words decoded; an unknown or wrong charset is read as Latin-1, null as the empty text."""
    from email.header import decode_header

    def one(value: str | None) -> str:
        out = []
        for part, charset in decode_header(value or ""):
            if isinstance(part, str):
                out.append(part)
                continue
            try:
                out.append(part.decode(charset or "utf-8", "replace"))
            except LookupError:
                out.append(part.decode("latin-1"))
        return "".join(out)

    return text.map(one)


def body(plain: Column, html: Column) -> Column:
    """The plain part, and the HTML part after its mark."""
    return F.concat_ws("\n", F.nullif(plain, F.lit("")), F.when(F.length(html) > 0, F.concat(F.lit(HTML_MARK), F.lit("\n"), html)))


def plain_part(text: Column) -> Column:
    return F.regexp_replace(F.split_part(text, F.lit(HTML_MARK), F.lit(1)), r"^\s+|\s+$", "")


def html_part(text: Column) -> Column:
    return F.regexp_replace(F.split_part(text, F.lit(HTML_MARK), F.lit(2)), r"^\s+|\s+$", "")


def sender(text: Column) -> Column:
    """struct<name, address> of 'Name <address>', cut at the last bracket; without brackets all of it is the address."""
    t = F.coalesce(text, F.lit(""))
    named = F.contains(t, F.lit("<")) & F.contains(t, F.lit(">"))
    name = F.regexp_replace(F.trim(F.regexp_replace(t, r"<[^<]*$", "")), "^[\"']+|[\"']+$", "")
    address = F.trim(F.regexp_replace(F.substring_index(t, "<", -1), ">+$", ""))
    return F.struct(F.when(named, name).otherwise(F.lit("")).alias("name"), F.when(named, address).otherwise(F.trim(t)).alias("address"))


def mail_date(date: Column, received: Column, today: Column) -> Column:
    """The Date header; else the first Received header (array) with a date after its last semicolon; else today."""
    after = F.transform(F.filter(received, lambda r: F.contains(r, F.lit(";"))), lambda r: header_date(F.trim(F.substring_index(r, ";", -1))))
    given = F.nullif(F.trim(date), F.lit(""))
    return F.when(given.isNotNull(), header_date(given)).otherwise(F.coalesce(F.get(F.array_compact(after), F.lit(0)), today))


def attachments(mails: DataFrame) -> DataFrame:
    """A row for each PDF or XML part of mails (email_id, subject, parts array<struct<filename, content>>)."""
    p = mails.select("email_id", "subject", F.explode("parts").alias("p")).select("email_id", "subject", "p.filename", "p.content")
    return p.where(F.lower(F.col("filename")).rlike(r"\.(pdf|xml)$"))


def without_attachments(mails: DataFrame, attached: DataFrame, limit: int | None = None) -> DataFrame:
    """Mails that gave no attachment, the first `limit` of them by id if a limit is asked for."""
    rest = mails.join(attached.select("email_id").distinct(), "email_id", "left_anti")
    return rest if limit is None else rest.orderBy("email_id").limit(limit)


def texts(files: DataFrame, readers: list, schema: str = "path string, reader string, text string") -> DataFrame:
    """path, reader, text of files (path, content): the first reader of the list whose text is long enough. A reader has a
    name, a least length, and read(content: bytes) -> str, which may raise; adapters to PDF and OCR engines are readers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part.path, part.content, strict=True):
                name, text = None, ""
                for reader in readers:
                    try:
                        got = reader.read(content) or ""
                    except Exception:  # noqa: BLE001 - a reader's failure means the next one's turn
                        continue
                    if len(got.strip()) >= reader.least:
                        name, text = reader.name, got
                        break
                rows.append((path, name, text))
            yield pd.DataFrame(rows, columns=["path", "reader", "text"])

    return files.select("path", "content").mapInPandas(run, schema)


def native_text(simple: Column, layout: Column, least: int = 50, enough: int = 300, more: int = 100) -> Column:
    """Of a text layer read plainly and by layout: empty below `least`, plain if it is enough, layout if clearly longer."""
    n, m = (F.length(F.trim(F.coalesce(c, F.lit("")))) for c in (simple, layout))
    return F.when(n < least, F.lit("")).when(n >= enough, simple).when(m > n + more, layout).otherwise(simple)


def unlocked(content: bytes, candidates: list[str], opener):
    """What opener(content, password) gives without a password or with the first candidate that fits, None if none does.
    Passwords are never logged."""
    for password in (None, *candidates):
        try:
            return opener(content, password)
        except Exception:  # noqa: BLE001 - a wrong password
            continue
    return None
