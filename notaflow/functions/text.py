"""Text normalisation, lines, chunks and markup."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> dict[str, str]:
    """Letters of the Latin blocks that are a plain letter with marks, with that letter; marks of their own with none."""
    found = {}
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x300, 0x370)]:
        rest = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c))
        if rest != chr(i) and (rest == "" or rest.isascii() and rest.isalpha()):
            found[chr(i)] = rest
    return found


#: Characters and what they become; the marks at the end become nothing.
ACCENTED, PLAIN = ("".join(x) for x in zip(*sorted(_folds().items(), key=lambda x: (x[1] == "", x[0])), strict=True))


def present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def positive(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)) > 0


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used: as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks, composed ones and those with marks of their own."""
    return F.translate(text, ACCENTED, PLAIN)


def one_space(text: Column) -> Column:
    """Tabs and hard spaces become spaces, runs of spaces one; line ends stay."""
    return F.trim(F.regexp_replace(F.translate(text, " \t", "  "), " +", " "))


def for_extraction(text: Column, keep_e: bool = False) -> Column:
    """Dashes to '-', box glyphs (and Ê, ê unless kept) to spaces, runs of blanks to one."""
    dashed = F.translate(text, "­–—", "---")
    boxes = "�■□█ " + ("" if keep_e else "Êê")
    return F.regexp_replace(F.translate(dashed, boxes, " " * len(boxes)), "[ \\t]+", " ")


def compact(text: Column) -> Column:
    """Upper case letters and digits only, without accents."""
    return F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]+", "")


def unpair(word: Column) -> Column:
    """'LLOOCCAA' to 'LOCA': every second letter, where pairs are alike."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1), F.lit(2)), lambda i: F.substr(word, i, F.lit(2)))
    alike = F.size(F.filter(pairs, lambda p: F.left(p, F.lit(1)) == F.right(p, F.lit(1))))
    enough = F.when(F.length(word) <= 4, alike == F.size(pairs)).otherwise(alike * 10 >= F.size(pairs) * 7)
    ok = (F.length(word) % 2 == 0) & (F.length(word) >= 2) & enough
    return F.when(ok, F.array_join(F.transform(pairs, lambda p: F.left(p, F.lit(1))), "")).otherwise(word)


def party_key(name: Column) -> Column:
    """A name for comparison: one space, no label in front, upper case."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"(?i)^(nome|fornecedor|raz[aã]o social|benefici[aá]rio)\s*:\s*", ""))


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles out, tags to spaces, the five basic entities decoded, one space."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def template(message: Column) -> Column:
    """A log message with its numbers, times and file names masked, for grouping."""
    out = F.regexp_replace(message, r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", "<TS>")
    out = F.regexp_replace(out, r"[A-Za-z0-9_\-]+\.pdf", "<PDF>")
    out = F.regexp_replace(out, r"\[\d+/\d+\]", "[x/y]")
    return F.regexp_replace(out, r"\d+", "<N>")


def title(markdown: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+)$", 1), F.lit("")), F.lit("Sem título"))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words; a text of at most `size` words is one chunk."""
    words = F.split(F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " ")), " ")
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(F.size(words) <= size, F.array(F.array_join(words, " "))).otherwise(windows)


def chunk_key(source: Column, index: Column) -> Column:
    return F.md5(F.concat_ws("::", source, index.cast("string")))


def hits(text: Column, patterns, flags: str = "(?iu)") -> Column:
    """How many of the patterns a text has."""
    return sum((text.rlike(flags + p).cast("int") for p in patterns[1:]), text.rlike(flags + patterns[0]).cast("int"))


def matches_any(text: Column, patterns, flags: str = "(?iu)") -> Column:
    return F.coalesce(text.rlike(flags + "(?:" + "|".join(patterns) + ")"), F.lit(False))


def label_then_lines(lines: Column, label: str, below: int) -> Column:
    """The `below` lines after the first line with the label."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(label)), True)
    return F.when(at > 0, F.slice(lines, at.cast("int") + 1, below))


def around(text: Column, at: Column, before: int, after: int) -> Column:
    """The characters around a place (counted from 1)."""
    start = F.greatest(F.lit(1), at - before)
    return F.substr(text, start.cast("int"), (at - start + after).cast("int"))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<raw, start, end>> of all matches; start counts from 0, end is exclusive."""
    found, rest = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)

    def step(state: Column, pair: Column) -> Column:
        """pair: the text before a hit, and the hit."""
        start = state["at"] + F.length(pair["0"])
        end = start + F.length(pair["1"])
        hit = F.struct(pair["1"].alias("raw"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.array_append(state["hits"], hit).alias("hits"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int,end:int>>").alias("hits"))
    pairs = F.filter(F.arrays_zip(rest.alias("0"), found.alias("1")), lambda p: p["1"].isNotNull())
    return F.aggregate(pairs, begin, step, lambda s: s["hits"])


def masked(text: Column, *patterns: str) -> Column:
    """text with blanks in place of every hit, as many as it has characters, so that places in it are places in text."""
    for p in patterns:
        parts = F.arrays_zip(F.split(text, p).alias("0"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("1"))
        text = F.array_join(F.transform(parts, lambda x: F.concat(x["0"], F.repeat(F.lit(" "), F.length(F.coalesce(x["1"], F.lit("")))))), "")
    return text
