"""Brazilian dates in text. Two-digit years have a pivot of their own in each source, hence one function each."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"\b(\d{2})[/\-](\d{2})[/\-](\d{2,4})\b"


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))


def _parts(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_br(text: Column) -> Column:
    """d/m/yyyy or d/m/yy (00-68: 20yy, 69-99: 19yy), with / - or . between; null if it is none."""

    def made(p):
        d, m, y = (F.get(p, F.lit(i)).try_cast("int") for i in (0, 1, 2))
        short = (F.length(F.get(p, F.lit(2))) == 2).cast("int")
        return _made(y + short * F.when(y <= 68, 2000).otherwise(1900), m, d)

    clean = F.translate(F.regexp_replace(text, r"\s", ""), "-.", "//")
    return F.when(text.rlike(r"^\s*(?:\d\s*){1,2}[/.\-]\s*(?:\d\s*){1,2}[/.\-]\s*(?:(?:\d\s*){4}|(?:\d\s*){2})$"), let(F.split(clean, "/"), made))


def first_br(text: Column) -> Column:
    """The first thing that looks like a date, if it is one."""
    return parse_br(F.nullif(F.regexp_extract(text, DATE, 0), F.lit("")))


def _with_pivot(text: Column, pivot: int) -> Column:
    d, m, y = _parts(text, r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\s*$")
    return _made(F.when(y < 100, y + F.when(y <= pivot, 2000).otherwise(1900)).otherwise(y), m, d)


def body_date(text: Column, today: Column) -> Column:
    """A date in a mail's body; without a year it is the next such day from today's month on."""
    d, m, _ = _parts(text, r"^\s*(\d{1,2})[/.\-](\d{1,2})()\s*$")
    year = F.year(today) + F.when(m < F.month(today), 1).otherwise(0)
    return F.coalesce(_with_pivot(text, 50), _made(year, m, d))


def metadata_date(text: Column) -> Column:
    """dd/mm/yyyy text from a mail's metadata."""
    return F.date_format(_with_pivot(text, 30), "dd/MM/yyyy")


def iso_or_same(text: Column) -> Column:
    """yyyy-mm-dd as it is, d/m/yyyy turned round, anything else unchanged."""
    d, m, y = (F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i) for i in (1, 2, 3))
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(text)


def xml_date(text: Column) -> Column:
    day = F.substring_index(text, "T", 1)
    y, m, d = _parts(day, r"^(\d{4})-(\d{2})-(\d{2})$")
    return F.coalesce(_made(y, m, d), parse_br(F.when(day.rlike(r"^\d{2}/\d{2}/\d{4}$"), day)))


def header_date(text: Column) -> Column:
    """A mail header's date: RFC 2822, ISO, dd/mm/yyyy; the zone is dropped."""
    rfc = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("")), F.lit("d MMM yyyy")))
    return F.coalesce(rfc, xml_date(F.trim(text)))


def due_from_factor(factor: Column, cycle: str = "reference") -> Column:
    """Due date of a slip's four-digit factor, counted from 1997-10-07; dates before 2020 are of the next cycle.

    cycle 'reference' adds 10000 days; 'febraban' 9000, as the counter began anew at 1000. Null outside 2020-2045.
    """
    first = F.date_add(F.lit("1997-10-07").cast("date"), factor.cast("int"))
    day = F.when(F.year(first) < 2020, F.date_add(first, 10000 if cycle == "reference" else 9000)).otherwise(first)
    return F.when((factor > 0) & F.year(day).between(2020, 2045), day)


def factor_of_line(line: Column) -> Column:
    return F.substring(F.regexp_replace(line, r"\D", ""), 34, 4).try_cast("int")


def due_faults(text: Column) -> Column:
    """What is wrong with a due date, as an array of codes."""
    day = parse_br(text)
    empty = text.isNull() | (F.trim(text) == "")
    zero = text.rlike(r"^0{1,2}/0{1,2}/0{2,4}$")
    return F.array_compact(F.array(
        F.when(empty, F.lit("VAZIO")), F.when(zero, F.lit("ZERADO")), F.when(~empty & ~zero & day.isNull(), F.lit("FORMATO")),
        F.when(text.rlike(r"/0000$"), F.lit("ANO_ZERO")), F.when(~F.year(day).between(2020, 2035), F.lit("FORA_DO_INTERVALO"))))
