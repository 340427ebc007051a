"""Did any patient value reach the scanned text?  One row, and it fails closed."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakstone.functions.detectors import DEFAULT_PATTERNS, TextPattern, any_pattern
from cloakstone.functions.text import contains_any
from cloakstone.operators.scan import locator, pattern_candidates
from cloakstone.operators.values import (
    ValueFilter, adjudicate, build_filter, compared_cells, found_per_column, scan_summary, scanner, settle,
)
from cloakstone.sources.canary import Canary
from cloakstone.sources.session import keep
from cloakstone.sources.tables import table_lines


class BoundaryBreached(RuntimeError):
    """A patient value crossed, or the check could not be made; names no value."""


def check_boundary(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    canary: Canary,
    data: list[DataFrame],
    identifier_columns: list[str],
    gaps: DataFrame | None,
    patterns: tuple[TextPattern, ...] = DEFAULT_PATTERNS,
) -> DataFrame:
    """One verdict row over a text table.

    ``data`` lists the tables suspected strings are settled against; the first one is the
    raw table whose identifier values are compared with every text.  ``gaps`` is the result
    of the sequence check, without default because a log with a hole proves nothing; give None only
    for texts that do not come from an event log.  Cheap checks
    name the failure first: planted values, then settled lookalikes, then real values.

    The texts are read once: one pass looks for planted values, shapes and identifier values, and counts.
    """
    planted = {k: v for k, v in canary.values().items() if v}
    cells = keep(compared_cells(data[0], identifier_columns, distinct=True), "compared")
    spotted = keep(_one_pass(texts, id_column, text_column, planted, patterns, build_filter(cells)), "spotted")
    # Distinct matches with counts, combined before the shuffle.
    matches = spotted.where("kind = 'shape'").groupBy("severity", "label", "match").agg(F.sum("n").alias("n"))
    found = matches.agg(
        F.coalesce(F.sum(F.when(F.col("severity") == "canary", F.col("n"))), F.lit(0)).alias("canary_hits"),
        F.coalesce(F.sum(F.when(F.col("severity") == "pattern", F.col("n"))), F.lit(0)).alias("pattern_hits"),
    )
    lines = None
    for table in data:
        rows = table.select(F.lit(0).alias("source"), table_lines(table).alias("line"))
        lines = rows if lines is None else lines.union(rows)
    settled = adjudicate(pattern_candidates(matches, canary.values()), lines, "source", "line").agg(
        F.count(F.lit(1)).alias("lookalikes"), F.count_if("leaked").alias("lookalikes_real")
    )
    survivors = spotted.where("kind = 'value'").select(
        "id", F.col("match").alias("value"), F.col("n").alias("occurrences")
    )
    compared = scan_summary(
        found_per_column(cells, settle(survivors, "id", cells.select("value"))),
        [c for c in identifier_columns if c in data[0].columns],
    ).select("columns_checked", "values_compared", "values_found", F.col("complete").alias("compared"))
    read = spotted.where("kind = 'read'").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars_scanned")
    )
    parts = [read, found, settled, compared]
    if gaps is not None:
        parts.append(gaps.agg(F.count_if(~F.col("complete")).alias("sessions_incomplete")))
    row = side_by_side(parts)
    if gaps is None:
        row = row.withColumn("sessions_incomplete", F.lit(0).cast("bigint"))
    failure = (
        F.when(F.col("canary_hits") > 0, "canary")
        .when(F.col("lookalikes_real") > 0, "lookalike found in the data")
        .when(F.col("values_found") > 0, "identifier value")
        .when(~F.col("compared"), "no values compared")
        .when(F.col("sessions_incomplete") > 0, "incomplete history")
    )
    return row.withColumns({"first_failure": failure, "passed": failure.isNull()}).drop("compared")


_SPOTTED = "kind string, id string, severity string, label string, match string, n long, chars long"


def _one_pass(
    texts: DataFrame, id_column: str, text_column: str, planted: dict[str, str],
    patterns: tuple[TextPattern, ...], filtered: ValueFilter,
) -> DataFrame:
    """Shapes (counted per batch), survivors of the value filter, and what was read, from one scan."""
    text = F.col(text_column)
    suspicious = contains_any(text, list(planted.values())) | any_pattern(text, patterns)
    locate, scan = locator(planted, patterns, "id", 0), scanner(filtered, "id")
    names = [part.split()[0] for part in _SPOTTED.split(", ")]

    def plain(rows: pd.DataFrame) -> pd.DataFrame:
        """All columns, missing cells None."""
        rows = rows.reindex(columns=names).astype(object)
        return rows.where(rows.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"kind": "read", "n": len(batch), "chars": int(batch["text"].str.len().sum())}]
            shapes: Counter = Counter()
            for found in locate(iter([batch[batch["suspicious"]]])):
                shapes.update(zip(found["severity"], found["label"], found["match"], strict=True))
            rows += [{"kind": "shape", "severity": s, "label": k, "match": m, "n": n} for (s, k, m), n in shapes.items()]
            yield plain(pd.DataFrame(rows))
            for found in scan(iter([batch])):
                yield plain(found.rename(columns={"value": "match", "occurrences": "n"}).assign(kind="value"))

    prepared = texts.select(
        F.col(id_column).cast("string").alias("id"), F.coalesce(F.make_valid_utf8(text), F.lit("")).alias("text"),
        F.coalesce(suspicious, F.lit(False)).alias("suspicious"),
    )
    return prepared.mapInPandas(run, _SPOTTED)


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row frames as one row: stacked as (name, value) and gathered again, without a join."""
    kinds = {name: kind for part in parts for name, kind in part.dtypes}

    def entry(name: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value"))

    stacked = [part.select(F.inline(F.array(*[entry(c) for c in part.columns]))) for part in parts]
    mine = {c: F.max(F.when(F.col("name") == c, F.col("value"))) for c in kinds}
    return functools.reduce(DataFrame.union, stacked).agg(
        *[value.cast(kinds[c]).alias(c) for c, value in mine.items()]
    )


def proof_summary(
    verdict: DataFrame, raw: DataFrame, identifier_columns: list[str], threads: DataFrame
) -> DataFrame:
    """The fields of a leak proof: data, transcript, checks, verdict."""
    rows = raw.agg(F.count(F.lit(1)).alias("data_rows"))
    subagents = threads.agg(F.count_if("is_subagent").alias("subagent_threads"))
    return side_by_side([verdict, rows, subagents]).select(
        "data_rows",
        F.lit(len(identifier_columns)).cast("bigint").alias("identifier_columns"),
        "subagent_threads", "texts", "chars_scanned", "canary_hits", "pattern_hits", "lookalikes",
        "lookalikes_real", "values_compared", "values_found", "sessions_incomplete", "first_failure", "passed",
    )


def assert_boundary(verdict: DataFrame, stage: str) -> dict:
    """Raise unless the verdict row passed."""
    row = verdict.first()
    if row is None or not row["passed"]:
        why = "no verdict" if row is None else row["first_failure"]
        raise BoundaryBreached(f"boundary breached during {stage}: {why}")
    return row.asDict()
