"""Column expressions on text: tokens, Unicode trimming, white space, escaping, excerpts."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]"

#: The characters of SPACE, one by one, but for the space: a split at one fixed character needs no regular expression.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tokens(text: Column | str) -> Column:
    """Lower-cased words: ASCII punctuation counts as white space; no stemming, no stop words."""
    column = F.col(text) if isinstance(text, str) else text
    apart = string.punctuation + _SPACES
    return F.filter(F.split(F.translate(F.lower(column), apart, " " * len(apart)), " "), lambda t: t != "")


def strip(text: Column) -> Column:
    """Trim Unicode white space (trim() knows only the space)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_space(text: Column) -> Column:
    """CR and CRLF to LF; runs of spaces and tabs to one space; three or more LF to two; strip."""
    out = F.regexp_replace(text, r"\r\n|\r", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def excerpt(text: Column, size: int = 800) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def fixed3(value: Column) -> Column:
    """The value with three decimals, rounded by its exact binary value and ties to even, as C and Python print it.

    format_string rounds the shortest decimal form half up, so 37.3035, which is stored as a
    little less, becomes 37.304 there.  Both halves of the fraction times 1000 are exact here.
    """
    size = F.abs(value)
    whole = F.floor(size).cast("double")
    fraction = size - whole
    high = F.floor(fraction * float(1 << 26)).cast("double") / float(1 << 26)
    thousandths = F.floor(fraction * 1000).cast("double")
    over = (high * 1000 - thousandths - 0.5) + (fraction - high) * 1000
    up = ((over > 0) | ((over == 0) & (thousandths % 2 == 1))).cast("double")
    rounded = F.signum(value) * ((whole * 1000 + thousandths + up) / 1000)
    return F.format_string("%.3f", F.when(size < float(1 << 40), rounded).otherwise(value))


def query_hash(query: Column) -> Column:
    return F.substring(F.md5(query), 1, 16)
