"""Brazilian amounts in text. Every function takes and gives Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = r"\b(\d{1,3}(?:\.\d{3})*,\d{2})\b"


def parse_br(text: Column) -> Column:
    """'1.234,56' to 1234.56; what is no amount gives 0.0."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.", ""), ",", ".")
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def repair_ocr(text: Column) -> Column:
    """Takes out spaces that OCR put into amounts; two finished amounts side by side stay apart."""
    tight = F.regexp_replace(text, r"(?<=\d)\s*([.,])\s*(?=\d)", "$1")
    return F.regexp_replace(tight, r"(?<!,\d\d)(?<=\d)[ \t]+(?=\d)", "")


def amounts(text: Column) -> Column:
    """All positive amounts of a text, in order."""
    found = F.transform(F.regexp_extract_all(repair_ocr(text), F.lit(AMOUNT), F.lit(1)), parse_br)
    return F.filter(found, lambda x: x > 0)


def largest(text: Column) -> Column:
    return F.coalesce(F.array_max(amounts(text)), F.lit(0.0))


def sheet_number(value: Column) -> Column:
    """A spreadsheet cell: a plain number, or a Brazilian one where it has a comma."""
    return F.when(F.contains(value, F.lit(",")), parse_br(value)).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.0)))


def xml_number(value: Column) -> Column:
    """Both separators: Brazilian; a comma alone: decimal comma; else plain; null if it is no number."""
    dot, comma = F.contains(value, F.lit(".")), F.contains(value, F.lit(","))
    brazilian = F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(dot & comma, brazilian).when(comma, F.replace(value, F.lit(","), F.lit("."))).otherwise(value).try_cast("double")


def of_slip_line(line: Column) -> Column:
    """The amount in a slip's digit line: its last ten digits are cents."""
    return F.right(F.regexp_replace(line, r"\D", ""), F.lit(10)).try_cast("bigint") / 100


def render_br(value: Column) -> Column:
    """1234.56 to '1.234,56'."""
    return F.translate(F.format_number(value, 2), ",.", ".,")
