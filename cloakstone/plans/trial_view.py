"""A raw trial table derived from ``orders``, one participant per order.

The cells are expressions over the order's own columns in the SQL that Spark and DuckDB share, so
both engines read the same table and it grows with the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The columns of a trial table.
COLUMNS = [
    "subject_id", "patient_name", "ssn", "mrn", "dob", "email", "phone", "address", "site",
    "arm", "baseline", "followup", "outcome_measure", "adverse_event",
]
# Invented words.
GIVEN = "Orla,Bram,Saskia,Emeka,Lotte,Anders,Mirela,Tobias,Yasmin,Cormac,Ingeborg,Paloma"
FAMILY = "Hartwell,Osei,Lindqvist,Marlowe,Petrov,Quigley,Santangelo,Thornbury,Vasquez,Wetherby,Zielinski"
STREET = "Mill Street,Harbour Road,Chapel Row,Orchard Close"
# Month names, and the words a flag may be written with.
MONTH = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"
YES, NO = "TRUE,yes,1,Y,Yes", "0,No,FALSE,n,no"


def _pick(words: str, number: str) -> str:
    return f"split_part('{words}', ',', CAST({number} % {words.count(',') + 1} + 1 AS INT))"


def _text(number: str, width: int = 0) -> str:
    text = f"CAST({number} AS STRING)"
    return f"lpad({text}, {width}, '0')" if width else text


def _tenths(value: str, other: str) -> str:
    """Tenths as text, some with a unit glued on, some padded."""
    whole = f"CAST(CAST(floor(abs({value}) / 10.0) AS BIGINT) AS STRING)"
    digits = f"concat(CASE WHEN {value} < 0 THEN '-' ELSE '' END, {whole}, '.', CAST(abs({value}) % 10 AS STRING))"
    return f"CASE {other} % 16 WHEN 3 THEN concat({digits}, ' mm') WHEN 9 THEN concat('  ', {digits}) ELSE {digits} END"


def _spelling(value: str, other: str) -> str:
    return (
        f"CASE {other} % 10 WHEN 2 THEN lower({value}) WHEN 5 THEN concat({value}, ' ') WHEN 7 THEN upper({value}) "
        f"WHEN 8 THEN concat('  ', {value}) ELSE {value} END"
    )


_READ = (
    "o_orderkey AS i, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS gone, "
    "o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS grade, o_custkey % 2 = 0 AS active, "
    "year(o_orderdate) - 30 - o_custkey % 45 AS y, month(o_orderdate) AS m, least(day(o_orderdate), 28) AS d"
)
_SCORED = (
    "*, 200 + p % 600 AS b, greatest(0, 200 + p % 600 - CASE WHEN active THEN 47 ELSE 21 END + (p * 7 + i * 31) % 151 - 75) AS f"
)
_LINE = f"concat('01', {_text('i % 100', 2)})"
_CELLS = {
    "subject_id": f"concat('STUDY-', {_text('i', 7)})",
    "patient_name": _spelling(f"concat({_pick(GIVEN, 'c')}, ' ', {_pick(FAMILY, 'p')})", "i"),
    "ssn": f"concat('9', {_text('c % 100', 2)}, '-', {_text('i % 89', 2)}, '-', {_text('i % 10000', 4)})",
    "mrn": f"concat('MRN', {_text('100000 + (i * 13) % 900000')})",
    "dob": (
        f"CASE c % 4 WHEN 0 THEN concat({_text('y')}, '-', {_text('m', 2)}, '-', {_text('d', 2)}) "
        f"WHEN 1 THEN concat({_text('m', 2)}, '/', {_text('d', 2)}, '/', {_text('y')}) "
        f"WHEN 2 THEN concat({_text('d')}, ' ', {_pick(MONTH, '(m - 1)')}, ' ', {_text('y')}) "
        f"ELSE concat({_pick(MONTH, '(m - 1)')}, ' ', {_text('d')}, ', ', {_text('y')}) END"
    ),
    "email": (
        f"CASE WHEN status = 'F' AND i % 13 = 0 THEN '' WHEN c % 8 = 5 THEN concat('P', {_text('i')}, '@EXAMPLE.COM') "
        f"ELSE concat('p', {_text('i')}, '@example.com') END"
    ),
    "phone": (
        f"CASE WHEN i % 31 = 0 THEN '' WHEN c % 4 = 0 THEN concat('555-555-', {_LINE}) WHEN c % 4 = 1 THEN concat('555.555.', {_LINE}) "
        f"WHEN c % 4 = 2 THEN concat('(555) 555-', {_LINE}) ELSE concat('+1 555 555 ', {_LINE}) END"
    ),
    "address": f"concat({_text('10 + i % 990')}, ' ', {_pick(STREET, 'c')}, ', Stonebridge, VT 05', {_text('p % 1000', 3)})",
    "site": "concat('SITE-0', grade)",
    "arm": _spelling("CASE WHEN active THEN 'Treatment' ELSE 'Placebo' END", "p"),
    "baseline": _tenths("b", "i"),
    "followup": f"CASE WHEN gone THEN '' ELSE {_tenths('f', 'p')} END",
    "outcome_measure": f"CASE WHEN gone THEN '' ELSE {_tenths('(f - b)', 'c')} END",
    "adverse_event": (
        f"CASE WHEN (p + 3 * c) % 100 < CASE WHEN active THEN 22 ELSE 15 END THEN {_pick(YES, 'i')} ELSE {_pick(NO, 'i')} END"
    ),
}
assert list(_CELLS) == COLUMNS
_SELECTED = [f"{cell} AS {name}" for name, cell in _CELLS.items()]


def trial_view(orders: DataFrame, keep_key: bool = False) -> DataFrame:
    """The table; ``keep_key`` adds the order's key as ``i``."""
    placed = orders.selectExpr(*_split(_READ)).selectExpr(*_split(_SCORED))
    return placed.selectExpr(*(["i"] if keep_key else []), *_SELECTED)


def _split(columns: str) -> list[str]:
    """Top-level commas only."""
    parts, depth, here = [], 0, ""
    for sign in columns:
        depth += (sign == "(") - (sign == ")")
        if sign == "," and not depth:
            parts.append(here)
            here = ""
        else:
            here += sign
    return [*parts, here]


TRIAL_SQL = f"""
trial_read AS (SELECT {_READ} FROM orders),
trial_scored AS (SELECT {_SCORED} FROM trial_read),
trial AS (SELECT i, {', '.join(_SELECTED)} FROM trial_scored)"""
