"""Markup protected by private characters, so that other tools may work on the text between.

All is done by SQL functions: a text is split at its tokens, which one regular expression finds for Spark and for Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, display and inline math, macros with their arguments, and private characters that a text has already. The loop
#: over arguments is possessive, so that Java runs it without recursion; what can't begin a token is told by one look.
TOKEN = re.compile(r"(?s)(?=[%\\$\uE000-\uF8FF])(?:(?<!\\)%[^\n]*\n?|\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|\$[^$]*\$|\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*+|\\[^A-Za-z]|[\uE000-\uF8FF])")
#: The private area of the basic plane: its first character begins a code, the others are the digits of a number.
FIRST, DIGITS = 0xE000, 6399
CODE = re.compile(r"\uE000([\uE001-\uF8FF]+)")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, for use in functions over arrays, which work out again for each element
    what isn't a variable of theirs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def between(c: Column, pattern: str, shown: Callable[[Column], Column]) -> Column:
    """A text with what stands for each match of a pattern; matches aren't empty."""
    parts = F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x, m: F.concat(x, F.when(m.isNull(), "").otherwise(shown(m))))
    return F.array_join(parts, "")


def _code(i: Column) -> Column:
    # a character of the basic plane is its number in UTF-16
    digit = lambda k: F.decode(F.unhex(F.hex(k % DIGITS + FIRST + 1)), "UTF-16BE")
    high = lambda n: F.when(i >= n, digit(F.floor(i / n))).otherwise("")
    return F.concat(F.lit(chr(FIRST)), high(DIGITS**2), high(DIGITS), digit(i))


def _number(digits: Column) -> Column:
    value = lambda j: F.conv(F.substr(F.hex(F.encode(digits, "UTF-16BE")), 4 * j - 3, F.lit(4)), 16, 10).cast("long")
    most = F.lit(2**40)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0).cast("long"), lambda n, j: F.least(n * DIGITS + value(j) - FIRST - 1, most))


def tokens(c: Column) -> Column:
    """Distinct tokens of a text, in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN.pattern), F.lit(0)))


def protect(c: Column, toks: Column) -> Column:
    """The text with each token as a code of private characters, by its place in ``toks``, the text's own tokens."""
    return once(toks, lambda own: F.when(own.isNotNull(), between(c, TOKEN.pattern, lambda m: _code(F.array_position(own, m) - 1))))


def protected_length(c: Column, toks: Column) -> Column:
    """The number of characters of the protected text. Of the first 6,399 tokens all codes have two."""
    found = F.regexp_extract_all(c, F.lit(TOKEN.pattern), F.lit(0))
    short = F.length(c) + F.aggregate(found, F.lit(0), lambda n, m: n + 2 - F.length(m))
    return F.when(F.size(toks) <= DIGITS, short).otherwise(F.length(protect(c, toks)))


def restore(c: Column, toks: Column) -> Column:
    """The text with its tokens back."""

    def shown(own: Column, m: Column) -> Column:
        i = _number(F.substr(m, F.lit(2)))
        return once(i, lambda n: F.when(n < F.size(own), F.get(own, n.cast("int"))).otherwise(m))

    return once(toks, lambda own: F.when(own.isNotNull(), between(c, CODE.pattern, lambda m: shown(own, m))))
