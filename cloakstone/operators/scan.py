"""Leak scan of text tables: planted values, identifier shapes, redaction, candidates.

Spark decides in the JVM which texts can hold a hit at all; only those reach the Arrow
kernel that locates the hits, so clean texts never leave the JVM.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cloakstone.functions.detectors import DEFAULT_PATTERNS, TextPattern, any_pattern, passes
from cloakstone.functions.text import contains_any, masked

REVEALED_CONTEXT = 24  # characters either side, shown under reveal only
ROWS_AT_ONCE = 20_000  # hits handed back together, however many a text holds


def locator(canaries: dict[str, str], patterns: tuple[TextPattern, ...], id_name: str, context: int):
    """The kernel that finds every hit in batches of (id, text)."""
    planted = [("canary", f"canary:{k}", re.compile(re.escape(v))) for k, v in canaries.items() if v]
    gates = [
        (re.compile(gate), [("pattern", p.label, re.compile(p.regex)) for p in patterns if p.gate == gate])
        for gate in dict.fromkeys(p.gate for p in patterns)
    ]

    def searches(text: str) -> Iterator[tuple[str, str, re.Pattern]]:
        yield from planted
        for gate, gated in gates:
            if gate.search(text):
                yield from gated

    def found(batch: pd.DataFrame) -> Iterator[tuple]:
        for key, text in zip(batch[id_name], batch["text"], strict=True):
            for severity, label, regex in searches(text):
                for m in regex.finditer(text):
                    near = text[max(0, m.start() - context) : m.end() + context] if context else None
                    yield key, severity, label, m.start(), m.group(), near

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_name, "severity", "label", "offset", "match", "context"]
        for batch in batches:
            rows = found(batch)
            while chunk := list(itertools.islice(rows, ROWS_AT_ONCE)):
                yield pd.DataFrame(chunk, columns=names)

    return run


def raw_hits(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    canaries: dict[str, str] | None = None,
    patterns: tuple[TextPattern, ...] = DEFAULT_PATTERNS,
    allow: list[str] | DataFrame | None = None,
    context: int = 0,
) -> DataFrame:
    """Hits with the matched text, and ``context`` characters around it; for use inside the library.

    The allow-list (strings, or a table with a ``value`` column for a long one) drops pattern hits after they
    were located, so offsets stay those of the original text, and can never drop a canary hit.
    """
    planted = {k: v for k, v in (canaries or {}).items() if v}
    text = F.col(text_column)
    suspicious = contains_any(text, list(planted.values())) | any_pattern(text, patterns)
    schema = StructType(
        [
            texts.schema[id_column],
            StructField("severity", StringType()),
            StructField("label", StringType()),
            StructField("offset", LongType()),
            StructField("match", StringType()),
            StructField("context", StringType()),
        ]
    )
    hits = (
        texts.where(suspicious).select(id_column, F.make_valid_utf8(text).alias("text"))
        .mapInPandas(locator(planted, patterns, id_column, context), schema)
    )
    if isinstance(allow, DataFrame):
        known = allow.select(F.col("value").alias("allowed")).distinct()
        return hits.join(known, (F.col("match") == F.col("allowed")) & (F.col("severity") != "canary"), "left_anti")
    if allow:
        hits = hits.where((F.col("severity") == "canary") | ~F.col("match").isin(list(allow)))
    return hits


def scan_text(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    canaries: dict[str, str] | None = None,
    patterns: tuple[TextPattern, ...] = DEFAULT_PATTERNS,
    allow: list[str] | DataFrame | None = None,
    reveal: bool = False,
) -> DataFrame:
    """One row per hit: id, severity, label, offset (in characters), length, excerpt.

    The excerpt masks the match and shows none of its neighbours; ``reveal`` opts in to
    both, and only then does the result have a ``match`` column.
    """
    context = REVEALED_CONTEXT if reveal else 0
    hits = raw_hits(texts, id_column, text_column, canaries, patterns, allow, context)
    columns = [id_column, "severity", "label", "offset", F.length("match").cast("bigint").alias("length")]
    if reveal:
        return hits.select(*columns, "match", F.col("context").alias("excerpt"))
    return hits.select(*columns, masked(F.col("match")).alias("excerpt"))


def text_verdicts(texts: DataFrame, id_column: str, text_column: str, hits: DataFrame) -> DataFrame:
    """Per text: characters scanned, hits by severity, clean and canary-clean flags."""
    counted = hits.groupBy(id_column).agg(
        F.count_if(F.col("severity") == "canary").alias("canary_hits"),
        F.count_if(F.col("severity") == "pattern").alias("pattern_hits"),
    )
    return (
        texts.select(id_column, F.length(text_column).cast("bigint").alias("scanned_chars"))
        .join(counted, id_column, "left")
        .select(
            id_column,
            "scanned_chars",
            F.coalesce("canary_hits", F.lit(0)).alias("canary_hits"),
            F.coalesce("pattern_hits", F.lit(0)).alias("pattern_hits"),
        )
        .withColumns(
            {
                "clean": (F.col("canary_hits") == 0) & (F.col("pattern_hits") == 0),
                "canary_clean": F.col("canary_hits") == 0,
            }
        )
    )


def hit_summary(hits: DataFrame) -> DataFrame:
    """Hits and distinct matched strings, per label."""
    return (
        hits.groupBy("severity", "label", "match").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("severity", "label")
        .agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("distinct_matches"))
    )


def pattern_candidates(hits: DataFrame, canaries: dict[str, str] | None = None) -> DataFrame:
    """Distinct identifier-shaped strings to be settled against the data; canaries need no settling."""
    planted = [v for v in (canaries or {}).values() if v]
    shaped = hits.where("severity = 'pattern'").select(F.col("match").alias("candidate"))
    if planted:
        shaped = shaped.where(~F.col("candidate").isin(planted))
    return shaped.distinct()


def redact(
    texts: DataFrame,
    text_column: str,
    canaries: dict[str, str] | None = None,
    patterns: tuple[TextPattern, ...] = DEFAULT_PATTERNS,
) -> DataFrame:
    """Replace every hit by ``[label:redacted]``; JVM only, texts without a hit pass untouched."""
    text = F.col(text_column)
    for key, value in (canaries or {}).items():
        if value:
            text = F.replace(text, F.lit(value), F.lit(f"[canary:{key}:redacted]"))
    texts = texts.withColumn(text_column, text)
    # One projection per pattern: a gate is tested on the text as it stands by then.
    for pattern in patterns:
        replaced = F.regexp_replace(F.col(text_column), F.lit(pattern.regex), F.lit(pattern.placeholder))
        if pattern.needs is not None:
            gate = passes(F.col(text_column), pattern.needs)
            replaced = F.when(gate, replaced).otherwise(F.col(text_column))
        texts = texts.withColumn(text_column, replaced)
    return texts


def assert_aggregate_only(result: DataFrame, canaries: dict[str, str] | None = None) -> None:
    """Refuse a result table with an identifier shape or a planted value in any field."""
    flat = result.select(F.lit(0).alias("row"), F.to_json(F.struct("*")).alias("text"))
    found = hit_summary(raw_hits(flat, "row", "text", canaries)).collect()
    if found:
        what = ", ".join(f"{r['label']} x{r['hits']}" for r in sorted(found, key=lambda r: r["label"]))
        raise AssertionError(f"result withheld: it holds {what}")
