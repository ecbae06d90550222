"""String Column builders (X1-X6, X10, X12, F6). All JVM-side expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower_key(x) -> Column:
    """Case-insensitive text key."""
    return F.lower(_c(x))


def split_fixed(x, sep_regex: str, n: int) -> Column:
    """At most ``n`` parts, the last keeps the rest, padded with ``""``."""
    parts = F.split(_c(x), sep_regex, n)
    pad = F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(n) - F.size(parts)))
    return F.when(_c(x).isNull(), F.lit(None)).otherwise(F.concat(parts, pad))


def part(arr, i: int) -> Column:
    """Zero-based element of an array, NULL when out of range."""
    return F.get(_c(arr), i)


def first_token(x, sep: str = " ") -> Column:
    """First word; the rest is dropped."""
    return F.split_part(_c(x), F.lit(sep), F.lit(1))


# Characters that mean themselves in a pattern and in a replacement.
_PLAIN = set(string.ascii_letters + string.digits + " <>=,;:%&_'\"/")


def gsub(x, pattern: str, replacement: str) -> Column:
    """Replace every regex match. A pattern of plain characters needs no regex."""
    if pattern and _PLAIN.issuperset(pattern) and _PLAIN.issuperset(replacement):
        return F.replace(_c(x), F.lit(pattern), F.lit(replacement))
    return F.regexp_replace(_c(x), pattern, replacement)


def leading_digits(x) -> Column:
    """The digits 0-9 that a text begins with (``""`` where there are none)."""
    x = _c(x)
    return F.left(x, F.length(x) - F.length(F.ltrim(x, F.lit(string.digits))))


def replace_chars(x, chars: str, into: str) -> Column:
    """Character-wise replacement (``[/]`` -> ``-``)."""
    return F.translate(_c(x), chars, into)


def paste(*cols, sep: str = " ") -> Column:
    """Join text with a separator; a missing value pastes as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def blank_to_null(x) -> Column:
    """the empty string becomes NULL (exact match, no trimming)."""
    return F.when(_c(x) == "", F.lit(None)).otherwise(_c(x))


def percent_to_double(x) -> Column:
    """``"10.65%"`` -> 10.65; blanks and junk -> NULL (try_cast keeps ANSI quiet).

    Only a sign that other white space may follow needs the regex; an empty text, whose cast
    would fail by an exception, is not cast.
    """
    text = F.trim(_c(x))
    bare = F.when(text.endswith("%"), F.left(text, F.length(text) - 1)) \
        .when(text.contains("%"), F.regexp_replace(text, "%$", "")).when(text != "", text)
    return bare.try_cast("double")


# The number words of the engine-cylinder rule and its default.
CYLINDER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "eight": 8}
CYLINDER_DEFAULT = 12


def word_to_number(x, words: dict[str, int] | None = None, default: int = CYLINDER_DEFAULT) -> Column:
    """Dictionary lookup as a literal map; unknown words map to ``default``."""
    words = words or CYLINDER_WORDS
    lookup = F.create_map(*[v for k, n in words.items() for v in (F.lit(k), F.lit(n))])
    return F.coalesce(F.try_element_at(lookup, _c(x)), F.lit(default)).cast("int")
