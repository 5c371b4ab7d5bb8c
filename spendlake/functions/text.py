"""Text helpers as Column expressions.

All but ``let`` avoid lambdas, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ANY_SPACE = f"[{SPACES}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    For long rules over one text: without it the text's own expression would be repeated for
    every use, until the generated code is too large to compile.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def trimmed(c: Column | str) -> Column:
    """``strip``, but a text that begins and ends with a visible ASCII character is taken as it is.

    Trimming looks at every character of a text. Names ``c`` three times, so it is for columns and cheap expressions.
    """
    c = _col(c)
    return F.when(F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126), c).otherwise(strip(c))


def empty_to_null(c: Column) -> Column:
    """NULL for the empty string, naming ``c`` only once so that nested calls stay small."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    return empty_to_null(strip(c))


def first_non_blank(*cols: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), ANY_SPACE, " "))


def loose_text(c: Column | str) -> Column:
    """Lower case with every run of other characters than [a-z0-9] as one space."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Split on spaces; the empty string gives an empty array."""
    return F.array_remove(F.split(text, " "), "")


def tokenize(c: Column | str) -> Column:
    return words(loose_text(c))


def safe_key(c: Column | str) -> Column:
    """Path-safe text: spaces to underscores, other characters dropped, possibly empty."""
    lowered = F.replace(F.lower(strip(F.coalesce(_col(c), F.lit("")))), F.lit(" "), F.lit("_"))
    return F.regexp_replace(lowered, "[^a-z0-9_-]+", "")


def partition_key(c: Column | str) -> Column:
    """Path-safe key that is never empty: nothing left gives ``unknown``."""
    return F.regexp_replace(safe_key(c), "^$", "unknown")


def has_text(haystack: Column, needle: str) -> Column:
    """Literal substring test on lower-cased text; a blank needle passes every row."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    return F.coalesce(F.contains(F.lower(haystack), F.lit(needle)), F.lit(False))
