"""Embedded JSON objects as table functions of SQL.

``payloads_of(text)`` gives the objects of one text, for ``LATERAL``.  ``payloads_over`` reads a table of
pieces, ``TABLE(pieces) PARTITION BY key ORDER BY seq``, and finds objects that are cut over rows: the scanner
carries its depth, an open string, an open escape and the text of the open object from row to row, so a
piece is read once and only the open object is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_SPECIAL = re.compile(r'["\\{}]')


class BraceScanner:
    """Balanced top-level objects of a text that comes in pieces; braces inside strings do not count."""

    def __init__(self) -> None:
        self._depth, self._quoted, self._escaped = 0, False, False
        self._held: list[str] = []

    def feed(self, piece: str) -> Iterator[str]:
        begin = 0  # of what the open object has in this piece
        skip = 0 if self._escaped else -1  # the character behind a backslash means nothing
        self._escaped = self._escaped and not piece
        for m in _SPECIAL.finditer(piece):
            at, sign = m.start(), m.group()
            if at == skip:
                continue
            if self._quoted:
                if sign == "\\":
                    skip = at + 1
                    self._escaped = skip == len(piece)
                elif sign == '"':
                    self._quoted = False
            elif sign == '"':
                self._quoted = True
            elif sign == "{":
                if not self._depth:
                    begin = at
                self._depth += 1
            elif sign == "}" and self._depth:
                self._depth -= 1
                if not self._depth:
                    yield "".join([*self._held, piece[begin : at + 1]])
                    self._held = []
        if self._depth:
            self._held.append(piece[begin:])


class PayloadsOf:
    """ordinal, payload of each object in one text."""

    def eval(self, text: str):
        if text:
            yield from enumerate(BraceScanner().feed(text))


class PayloadsOver:
    """key, ordinal, payload of each object in the pieces (key, text) of one partition, in their order."""

    def __init__(self) -> None:
        self._scanner, self._found = BraceScanner(), 0

    def eval(self, row: Row):
        for payload in self._scanner.feed(row["text"] or ""):
            yield row["key"], self._found, payload
            self._found += 1


def register(spark: SparkSession) -> None:
    """Make both functions known to a session's SQL."""
    spark.udtf.register("payloads_of", F.udtf(PayloadsOf, returnType="ordinal bigint, payload string"))
    spark.udtf.register("payloads_over", F.udtf(PayloadsOver, returnType="key string, ordinal bigint, payload string"))


def payloads_over(pieces: DataFrame) -> DataFrame:
    """key, ordinal, payload of the objects in pieces (key, seq, text), wherever they are cut; JSON only."""
    spark = pieces.sparkSession
    register(spark)
    return spark.sql(
        "SELECT * FROM payloads_over(TABLE(SELECT key, seq, text FROM {pieces}) PARTITION BY key ORDER BY seq) "
        "WHERE try_parse_json(payload) IS NOT NULL",
        pieces=pieces,
    )
