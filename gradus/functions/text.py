"""Text normalisers and tokens as column expressions.

fold maps each precomposed letter whose decomposition is one ASCII letter to that letter by
a generated table, and drops combining marks; no user-defined function.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Lower-case letters with accents, and the ASCII letters they fold to."""
    rows = [("đ", "d")]
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if c == c.lower() and len(base) == 1 and base[0].isascii() and base[0].isalpha():
            rows.append((c, base[0].lower()))
    return "".join(a for a, _ in rows), "".join(b for _, b in rows)


def fold(text: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    return F.regexp_replace(F.translate(F.lower(text), *fold_table()), r"\p{M}+", "")


def slug(text: Column, empty_is_null: bool = False) -> Column:
    """Folded text, all else than a-z and 0-9 as single spaces."""
    out = F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))
    return F.nullif(out, F.lit("")) if empty_is_null else out


def slug_keep_runs(text: Column) -> Column:
    """Folded text, other signs as one space each; inner runs of spaces stay."""
    return F.trim(F.regexp_replace(fold(text), r"[^a-z0-9\s]", " "))


def ascii_only(text: Column) -> Column:
    """Lower case; letters without an ASCII decomposition are dropped, spaces collapse."""
    dropped = F.regexp_replace(F.translate(F.replace(F.lower(text), F.lit("đ"), F.lit("")), *fold_table()), r"[^\x00-\x7f]+", "")
    return F.trim(F.regexp_replace(dropped, r"\s+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column, stop: list[str], most: int) -> Column:
    """The first folded words of three or more letters that aren't stop words."""
    words = F.regexp_extract_all(fold(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(*stop)), 1, most)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def tag_list(rules: list[tuple[str, str]], text: Column, sep: str = "|") -> Column:
    """Names of all patterns that a text matches, in their order."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules])), sep)
