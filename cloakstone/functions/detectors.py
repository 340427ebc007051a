"""Whole-cell identifier detectors and free-text identifier patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    """A whole-cell shape.  Order matters: on equal rates the earlier detector wins.

    ``shortest``, ``longest`` and ``needs`` follow from the regex and are tested first,
    so most cells never meet it.
    """

    pii_type: str
    regex: str
    shortest: int = 1
    longest: int | None = None
    needs: str | None = None

    def matches(self, stripped: Column, unicode: bool = False) -> Column:
        # (?d): only \n ends a line, so "." means the same in every engine.
        flags = "(?dU)" if unicode else "(?d)"
        cheap = F.length(stripped) >= self.shortest
        if self.longest is not None:
            cheap = cheap & (F.length(stripped) <= self.longest)
        if self.needs is not None:
            cheap = cheap & F.contains(stripped, F.lit(self.needs))
        return cheap & F.regexp_like(stripped, F.lit(flags + self.regex))


# Identifier types and their whole-cell shapes, strictest first.
DETECTORS: tuple[Detector, ...] = (
    Detector("ssn", r"^\d{3}-\d{2}-\d{4}$", 11, 11),
    Detector("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", 6, None, "@"),
    Detector("phone", r"^\+?1?[\s.\-]*\(?\d{3}\)?[\s.\-]*\d{3}[\s.\-]*\d{4}$", 10),
    Detector(
        "dob",
        r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}"
        r"|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})$",
        8,
    ),
    Detector("mrn", r"^[A-Za-z]{2,4}\d{5,10}$", 7, 14),
    Detector("study_id", r"^[A-Za-z]{2,10}[-_]\d{3,10}$", 6, 21),
    Detector("address", r"^\d+\s+.+,\s*.+,\s*[A-Za-z]{2}\s+\d{5}$", 14, None, ","),
    Detector("name", r"^[A-Za-z][A-Za-z'\-]*(?:\s+[A-Za-z][A-Za-z'\-]*)+$", 3),
)

# How a column's text is typed when every populated cell fits.
INTEGER_SHAPE = r"^[+-]?\d{1,18}$"
DECIMAL_SHAPE = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?$"
BOOLEAN_SHAPE = r"^(?:true|false|True|False|TRUE|FALSE)$"


@dataclass(frozen=True)
class TextPattern:
    """An identifier shape looked for anywhere in free text.

    ``regex`` is read alike by Java and Python: word edges are spelled as lookarounds
    over ASCII letters, digits and underscore, because the two disagree on ``\b``.  They
    stand after the first character, so both engines skip to it quickly, and every
    quantifier that could run over a long unbroken text is bounded.

    ``needs`` is a cheap regex (or plain string) that any text with a hit must contain.
    """

    label: str
    regex: str
    needs: str | None = None

    @property
    def placeholder(self) -> str:
        return f"[{self.label}:redacted]"

    @property
    def gate(self) -> str:
        return self.regex if self.needs is None else self.needs


_EDGE = r"(?<![A-Za-z0-9_][0-9])"  # stands behind a first digit
_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}"
_FOUR_DIGITS = r"[0-9]{4}"

DEFAULT_PATTERNS: tuple[TextPattern, ...] = (
    TextPattern(
        "us-ssn", r"[0-9]" + _EDGE + r"[0-9]{2}-[0-9]{2}-[0-9]{4}" + _END, _FOUR_DIGITS
    ),
    TextPattern(
        "email", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,24}", "@"
    ),
    TextPattern(
        "us-phone",
        r"(?=[0-9+(])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]" + _EDGE + r"[0-9]{2}[ .\-])"
        r"[0-9]{3}[ .\-][0-9]{4}" + _END,
        _FOUR_DIGITS,
    ),
    TextPattern(
        "date-of-birth",
        r"(?=[0-9JFMASOND])"
        + _START
        + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2} "
        + _MONTH
        + r" [0-9]{4}|"
        + _MONTH
        + r" [0-9]{1,2}, [0-9]{4})"
        + _END,
        _FOUR_DIGITS,
    ),
    TextPattern(
        "mrn",
        r"[Mm][Rr][Nn](?<![A-Za-z0-9_][A-Za-z]{3})[ :#\-]{0,2}[0-9]{5,10}" + _END,
        _FOUR_DIGITS,
    ),
    TextPattern(
        "us-street-address",
        r"[0-9]" + _EDGE + r"[0-9]{0,5} [A-Za-z][A-Za-z .'\-]{1,60}, [A-Za-z][A-Za-z .'\-]{1,60}, "
        r"[A-Za-z]{2} [0-9]{5}" + _END,
        _FOUR_DIGITS,
    ),
)


def passes(text: Column, gate: str) -> Column:
    """JVM test for one gate; a plain string is searched for without a regex."""
    if re.escape(gate) == gate:
        return F.contains(text, F.lit(gate))
    return F.regexp_like(text, F.lit(gate))


def any_pattern(text: Column, patterns: tuple[TextPattern, ...]) -> Column:
    """JVM-side test that lets only texts with a hit into the costly search.

    The cheap gate stands before the pattern itself, so a clean text costs one pass per gate.
    """
    suspicious = F.lit(False)
    for gate in dict.fromkeys(p.gate for p in patterns):
        found = F.lit(False)
        for p in patterns:
            if p.gate == gate:
                found = found | F.regexp_like(text, F.lit(p.regex))
        suspicious = suspicious | (passes(text, gate) & found)
    return suspicious
