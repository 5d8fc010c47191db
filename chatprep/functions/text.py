"""String helpers with code-point semantics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, written so that Java and RE2 read them alike.
SPACE_CHARS = (
    r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_CHARS = r"\p{L}\p{M}\p{N}_"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` only removes blanks)."""
    head = F.regexp_replace(text, rf"\A[{SPACE_CHARS}]+", "")
    return F.regexp_replace(head, rf"[{SPACE_CHARS}]+\z", "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE_CHARS}]+")).cast("bigint")


def quote_regex(literal: str) -> str:
    """Escape a literal so that both Java and RE2 match it verbatim."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def first_match(text: Column, pattern: str, group: int = 1, may_be_empty: bool = False) -> Column:
    """First match of a group, or null when the pattern does not occur.

    A group that cannot match the empty text needs one search, others need two.
    """
    found = F.regexp_extract(text, pattern, group)
    if may_be_empty:
        return F.when(F.regexp_like(text, F.lit(pattern)), found)
    return F.nullif(found, F.lit(""))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Last match of a group, or null when the pattern does not occur."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(-1))
