"""String helpers with the reference's whitespace and number-prefix rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The whitespace the reference trims and splits on. The first six
# are what a plain `\\s` covers; the rest occur in few lines.
ASCII_SPACES = "\t\n\x0b\f\r "
WIDE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WIDE_SET = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = rf"[\s{WIDE_SET}]"
NON_SPACE = rf"[^\s{WIDE_SET}]"

# Numeric prefixes, as read from the start of a string.
FLOAT_PREFIX = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
INT_PREFIX = r"([-+]?\d+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def only_ascii_spaces(c: Column | str) -> Column:
    """True where a plain `\\s` sees every space: pure ASCII, or no wide space in it."""
    text = col(c)
    return F.when(F.octet_length(text) == F.length(text), True).otherwise(~text.rlike(f"[{WIDE_SET}]"))


def wide_spaces(pattern: str) -> str:
    r"""Widen Java's ASCII `\s` / `\S` to the full whitespace set."""
    return pattern.replace(r"\S", NON_SPACE).replace(r"\s", SPACE)


def space_aware(c: Column | str, pattern: str, apply: Callable[[Column, str], Column]) -> Column:
    """`apply(text, pattern)`, with the many times slower wide pattern only where it can differ."""
    text = col(c)
    if not re.search(r"\\[sS]", pattern):
        return apply(text, pattern)
    return F.when(only_ascii_spaces(text), apply(text, pattern)).otherwise(apply(text, wide_spaces(pattern)))


def matches(c: Column | str, pattern: str) -> Column:
    return space_aware(c, pattern, lambda text, p: text.rlike(p))


def trim_space(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(ASCII_SPACES + WIDE_SPACES))


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(NON_SPACE)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def or_dash(c: Column | str) -> Column:
    """Empty or missing text shows as '-'."""
    return F.coalesce(blank_to_null(c), F.lit("-"))


def lenient_float(c: Column | str) -> Column:
    """Number at the start of the text, ignoring what follows; null if there is none."""
    return F.regexp_extract(col(c), f"^{SPACE}*{FLOAT_PREFIX}", 1).try_cast("double")


def lenient_int(c: Column | str, to: str = "int") -> Column:
    """Integer at the start of the text, ignoring what follows; null if there is none."""
    return F.regexp_extract(col(c), f"^{SPACE}*{INT_PREFIX}", 1).try_cast(to)


def duration_ms(c: Column | str, fix_ms: bool = False) -> Column:
    """Text ending in `s` is seconds, anything else is already milliseconds.

    `142ms` also ends in `s`, so it reads as 142 seconds; `fix_ms` reads it as
    milliseconds instead.
    """
    text = col(c)
    seconds = text.endswith("s")
    if fix_ms:
        seconds = seconds & ~text.endswith("ms")
    return F.when(seconds, lenient_float(text) * 1000).otherwise(lenient_float(text))
