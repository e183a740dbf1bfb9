"""Tax identifiers, invoice numbers, slip lines and file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NUMBER_IN_FILE_NAME
from .text import let

CNPJ = r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}"
CPF = r"\d{3}\.\d{3}\.\d{3}-\d{2}"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null."""
    return let(F.regexp_extract(text, pattern, group), lambda hit: F.nullif(hit, F.lit("")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def cnpj(text: Column) -> Column:
    return found(text, CNPJ)


def cpf(text: Column) -> Column:
    return found(text, CPF)


def cnpj_digits(text: Column) -> Column:
    """14 digits, or null."""
    d = digits(text)
    return F.when(F.length(d) == 14, d)


def format_cnpj(text: Column) -> Column:
    """Punctuated if there are 14 digits, else the digits as they are."""
    d = digits(text)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")).otherwise(d)


def flexible_cnpj(text: Column) -> Column:
    """The first 14 digits with at most one mark between their groups, punctuated."""
    pattern = r"(?:^|\D)(\d{2}\D?\d{3}\D?\d{3}\D?\d{4}\D?\d{2})(?:\D|$)"
    return F.nullif(format_cnpj(F.regexp_extract(text, pattern, 1)), F.lit(""))


def is_cnpj(text: Column) -> Column:
    return F.trim(text).rlike(rf"^{CNPJ}$")


def is_cpf(text: Column) -> Column:
    return F.trim(text).rlike(rf"^{CPF}$")


def all_cnpjs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"({CNPJ})"), F.lit(1)), digits))


def domains(text: Column) -> Column:
    """Domains of addresses, then bare ones; distinct, in order."""
    mail = F.regexp_extract_all(F.lower(text), F.lit(r"@([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))
    bare = F.regexp_extract_all(F.lower(text), F.lit(r"https?://(?:www\.)?([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))
    return F.array_distinct(F.concat(mail, bare))


def access_key(text: Column) -> Column:
    return found(digits(text), r"(\d{44})", 1)


def slip_line(text: Column) -> Column:
    """A slip's digit line: spaced and dotted, or 47 to 48 digits in a row."""
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    spaced = r"(\d{5}\.?\d{5}\s+\d{5}\.?\d{6}\s+\d{5}\.?\d{6}\s+\d\s+\d{14})"
    return F.coalesce(found(flat, spaced, 1), found(flat, r"(?:^|\D)(\d{47,48})(?:\D|$)", 1))


def invoice_number(text: Column) -> Column:
    """The significant part of an invoice number: '2025/119', '202500000000119' and '00119' are all '119'. A year in front goes
    only from more than 8 digits that count, so zeros in front don't make one of '002025119'."""
    def significant(bare: Column) -> Column:
        def of(yearly: Column, counted: Column) -> Column:
            plain = F.when(F.length(counted) > 8, F.regexp_replace(counted, r"^20(2\d|30)", "")).otherwise(counted)
            return F.ltrim(F.when(yearly != "", yearly).otherwise(plain), F.lit("0"))

        number = let(F.ltrim(digits(bare), F.lit("0")), lambda counted: let(F.regexp_extract(bare, r"^\d{4}[./\-](\d+)$", 1), lambda yearly: of(yearly, counted)))
        return let(number, lambda n: F.when(n != "", n).when(bare.rlike(r"\d"), F.lit("0")))

    return let(F.regexp_replace(F.upper(F.trim(text)), r"^(NFSE|NFE|NOTA|NF)[\s._:\-]*", ""), significant)


def number_of_file(name: Column) -> Column:
    """An invoice number in a file name, by the first pattern that matches."""
    return F.coalesce(*[found(name, f"(?i){p}", 1) for p in NUMBER_IN_FILE_NAME])


def same_number(a: Column, b: Column) -> Column:
    """Equal, equal without leading zeros, or one ends with the other."""
    x, y = F.regexp_replace(a, "^0+", ""), F.regexp_replace(b, "^0+", "")
    return (a != "") & (b != "") & ((x == y) | F.endswith(a, y) | F.endswith(b, x))


def company_code(name: Column) -> Column:
    """First word of 2 to 15 letters or digits, brackets left out."""
    return found(F.upper(F.regexp_replace(name, r"\([^)]*\)", " ")), r"([A-Z0-9]{2,15})", 1)


def batch_id(message_id: Column) -> Column:
    """A batch's name hangs on its message alone, so a second delivery has the same."""
    return F.concat(F.lit("email_"), F.substring(F.sha2(message_id, 256), 1, 16))


def safe_file_name(name: Column, longest: int = 200) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", " "))
    ending = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    return F.when(F.length(clean) > longest, F.concat(F.left(clean, F.lit(longest) - F.length(ending)), ending)).otherwise(clean)


def order_number(text: Column) -> Column:
    return F.coalesce(*[found(text, p, 1) for p in (r"(?i)pedido\s*(?:n[ºo°.]*)?\s*[:#]?\s*(\d+)", r"(?i)\bpc\s*[:#]?\s*(\d+)", r"(?i)ordem\s+de\s+compra\s*[:#]?\s*(\d+)")])
