"""Does anything identifying survive in a table?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakstone.functions.text import as_text, contains_any
from cloakstone.operators.classify import assemble, classify, profile_columns, rate_columns
from cloakstone.sources.canary import CanaryError, parse_canary

VERIFICATION_SCHEMA = (
    "schema_version int, check string, row_count bigint, columns array<string>, "
    "surviving_identifier_columns array<struct<name:string,pii_type:string,match_rate:double>>, "
    "canary_present boolean, run_id string, passed boolean, error string"
)


def surviving_identifiers(df: DataFrame) -> DataFrame:
    """Columns typed by what they hold, whatever they are called."""
    return (
        classify(df).where("pii_type is not null")
        .select("ordinal", "name", "pii_type", "match_rate")
    )


def canary_counts(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Rows holding each planted value anywhere, free-text columns included."""
    row = F.concat_ws("\n", *[as_text(c) for c in df.columns])
    return df.agg(
        *[F.count_if(contains_any(row, [v])).alias(f"rows_with_{k}") for k, v in values.items()]
    )


def verify(
    df: DataFrame,
    canary: str | None = None,
    run_id: str | None = None,
    canary_required: bool = False,
) -> DataFrame:
    """One verification row.

    ``canary`` is the text of the side record.  When it is required and missing, or
    malformed, the row fails and says why: a check that cannot run never passes.
    The canary search shares the classification scan.
    """
    error, planted = None, None
    if canary is None and canary_required:
        error = "canary record not found"
    elif canary is not None:
        try:
            planted = parse_canary(canary)
        except CanaryError as problem:
            error = str(problem)
    extra = {}
    if planted is not None:
        extra["n_canary"] = F.count_if(contains_any(F.col("value"), [planted.ssn, planted.name]))
    rated = rate_columns(profile_columns(df, extra=extra), carry=tuple(extra)).collect()
    verdict = assemble(df, rated).collect()
    survivors = [
        (r["name"], r["pii_type"], r["match_rate"])
        for r in sorted(verdict, key=lambda r: r["ordinal"])
        if r["pii_type"] is not None
    ]
    rows = max((r["populated"] + r["blank"] for r in verdict), default=0)
    present = None if planted is None else any(r["n_canary"] > 0 for r in rated)
    passed = error is None and not survivors and not present
    return df.sparkSession.createDataFrame(
        [(1, "scrub", rows, list(df.columns), survivors, present, run_id, passed, error)],
        VERIFICATION_SCHEMA,
    ).coalesce(1)

