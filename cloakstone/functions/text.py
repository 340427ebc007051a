"""String expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank at the ends of a cell
# (all Unicode whitespace; Spark's own ``trim`` removes U+0020 only).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: shorter strings are never compared with text, because one-letter
# codes and two-digit numbers occur in any prose.
MIN_COMPARED_LENGTH = 5

# Fixed value: hex digits kept of a sha256 when a value has to be named.
FINGERPRINT_DIGITS = 12


def strip(value: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def as_text(name: str) -> Column:
    """A column as text with null read as the empty string."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.coalesce(F.col(quoted).cast("string"), F.lit(""))


def fingerprint(value: Column) -> Column:
    """Name a value without showing it."""
    return F.substring(F.sha2(value, 256), 1, FINGERPRINT_DIGITS)


def masked(value: Column) -> Column:
    """First and last three characters; nothing at all of a match that short would expose."""
    return F.when(
        F.length(value) >= 8,
        F.concat(F.left(value, F.lit(3)), F.lit("…"), F.right(value, F.lit(3))),
    ).otherwise(F.lit("…"))


def contains_any(text: Column, values: list[str]) -> Column:
    """True where any of a handful of driver-side strings occurs; empty strings never match."""
    found = F.lit(False)
    for value in values:
        if value:
            found = found | F.contains(text, F.lit(value))
    return found


def whole(number: Column, divisor: int) -> Column:
    """Integer division without a detour through double."""
    return F.call_function("div", number, F.lit(divisor))
