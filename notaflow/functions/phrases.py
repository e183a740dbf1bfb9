"""Tables of fixed phrases found in one pass over a text.

The phrases become one pattern in the shape of a tree of their common beginnings, so that at each place of the text the
matcher follows one branch, however many phrases there are. It is put into a look-ahead, so hits may overlap. All of it
is one built-in expression.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents


def tree_pattern(words) -> str:
    """A pattern for any of the words, the longest at a place; words with a common beginning share it."""
    def build(rest: list[str]) -> str:
        branches: dict[str, list[str]] = {}
        for w in rest:
            if w:
                branches.setdefault(w[0], []).append(w[1:])
        parts = [re.escape(c) + build(tails) for c, tails in branches.items()]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in rest else body

    return build(sorted(set(words)))


def bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def folded(text: Column) -> Column:
    """Upper case, no accents, single blanks."""
    return F.regexp_replace(strip_accents(F.upper(F.coalesce(text, F.lit("")))), r"\s+", " ")


def has_any(text: Column, words) -> Column:
    """Whether one of the words occurs."""
    return text.rlike(tree_pattern(words))


def hits(text: Column, words) -> Column:
    """The different words that occur, in order; words inside others too, and those that begin a longer one."""
    words = sorted(set(words))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({tree_pattern(words)}))"), F.lit(1)))
    longer = {w: [v for v in words if w != v and w.startswith(v)] for w in words}
    if not any(longer.values()):
        return found
    begins = F.create_map(*[x for w, v in longer.items() if v for x in (F.lit(w), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(begins, w), F.array().cast("array<string>"))))))
