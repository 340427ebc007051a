"""Schema-only typing of identifier columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.functions.detectors import (
    BOOLEAN_SHAPE,
    DECIMAL_SHAPE,
    DETECTORS,
    INTEGER_SHAPE,
    Detector,
)
from cloakstone.functions.text import MIN_COMPARED_LENGTH, as_text, strip

# A column is typed from half of its populated cells on; a study-number
# column is a direct identifier only where nearly every value is its own.
TYPED_FROM = 0.5
UNIQUE_FROM = 0.95

VERDICT_SCHEMA = (
    "ordinal int, name string, dtype string, populated bigint, blank bigint, "
    "pii_type string, match_rate double, any_identifier_rate double, example string"
)


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table as ``(ordinal, column, value)``, one row per cell, text as written."""
    names = columns if columns is not None else df.columns
    texts = df.select([as_text(n).alias(f"c{i}") for i, n in enumerate(names)])
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"), F.col(f"c{i}").alias("value"))
        for i, n in enumerate(names)
    ]
    return texts.select(F.inline(F.array(*entries)))


def profile_columns(
    df: DataFrame,
    detectors: tuple[Detector, ...] = DETECTORS,
    unicode: bool = False,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Counts per column: cells, populated cells, cells fitting each detector and each type.

    One narrow pass and a partial aggregate; the shuffle carries one row per column and
    task, however large or skewed the table is.  ``extra`` adds aggregates over ``value``.
    """
    tested = cells(df).select(
        "ordinal", "column", "value", strip(F.col("value")).alias("s")
    ).select(
        "*",
        *[d.matches(F.col("s"), unicode).alias(f"is_{d.pii_type}") for d in detectors],
    )
    hits = [F.col(f"is_{d.pii_type}") for d in detectors]
    any_hit = F.lit(False)
    for hit in hits:
        any_hit = any_hit | hit
    s = F.col("s")
    return tested.groupBy("ordinal", "column").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(s != "").alias("populated"),
        *[F.count_if(h).alias(f"n_{d.pii_type}") for d, h in zip(detectors, hits, strict=True)],
        F.count_if(any_hit).alias("n_any"),
        F.count_if(F.regexp_like(s, F.lit(INTEGER_SHAPE))).alias("n_integer"),
        F.count_if(F.regexp_like(s, F.lit(DECIMAL_SHAPE))).alias("n_decimal"),
        F.count_if(F.regexp_like(s, F.lit(BOOLEAN_SHAPE))).alias("n_boolean"),
        *[agg.alias(name) for name, agg in (extra or {}).items()],
    )


def rate_columns(
    profile: DataFrame,
    detectors: tuple[Detector, ...] = DETECTORS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Best type and rates per column, before the uniqueness rule; ``carry`` passes through."""
    counts = [F.col(f"n_{d.pii_type}") for d in detectors]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    winner = F.coalesce(
        *[F.when((c > 0) & (c == best), F.lit(d.pii_type)) for d, c in zip(detectors, counts, strict=True)]
    )
    populated = F.col("populated")
    full = lambda n: (populated > 0) & (F.col(n) == populated)
    rate = F.when(populated > 0, best / populated).otherwise(F.lit(0.0))
    return profile.select(
        "ordinal",
        F.col("column").alias("name"),
        F.when(full("n_integer"), "bigint")
        .when(full("n_decimal"), "double")
        .when(full("n_boolean"), "boolean")
        .otherwise("string")
        .alias("dtype"),
        "populated",
        (F.col("n_cells") - populated).alias("blank"),
        F.when(rate >= TYPED_FROM, winner).alias("best_type"),
        rate.alias("rate"),
        F.when(populated > 0, F.col("n_any") / populated).otherwise(F.lit(0.0)).alias("any_rate"),
        *carry,
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct populated values of the named columns.

    Duplicates collapse before the shuffle, so a value held by a third of the rows
    costs one row per task.
    """
    values = cells(df, columns).select("column", strip(F.col("value")).alias("s")).where("s <> ''")
    return (
        values.groupBy("column", "s").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def classify(
    df: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, unicode: bool = False
) -> DataFrame:
    """One row per column: inferred type, populated and blank counts, identifier type, rate.

    Only per-column counts reach the driver (one row per column).  They decide which
    columns need the uniqueness rule, so the second scan reads just those, or is skipped.
    """
    rated = rate_columns(profile_columns(df, detectors, unicode), detectors).collect()
    return assemble(df, rated)


def assemble(df: DataFrame, rated: list) -> DataFrame:
    """Apply the uniqueness rule to collected per-column rates and build the verdict rows."""
    numbered = [r["name"] for r in rated if r["best_type"] == "study_id"]
    distinct = {}
    if numbered:
        distinct = {r["column"]: r["n_distinct"] for r in distinct_counts(df, numbered).collect()}
    rows = []
    for r in sorted(rated, key=lambda r: r["ordinal"]):
        shared = r["name"] in distinct and distinct[r["name"]] / r["populated"] < UNIQUE_FROM
        rows.append(
            (
                r["ordinal"], r["name"], r["dtype"], r["populated"], r["blank"],
                None if shared else r["best_type"], r["rate"], r["any_rate"], None,
            )
        )
    verdict = df.sparkSession.createDataFrame(rows, VERDICT_SCHEMA).coalesce(1)
    return verdict.withColumns(
        {
            "match_rate": F.bround("match_rate", 4),
            "any_identifier_rate": F.bround("any_identifier_rate", 4),
        }
    )


def verdict_document(verdict: DataFrame, run_id: str | None = None) -> DataFrame:
    """The verdict as one nested row; its keys are a closed set and ``example`` stays null."""
    entry = F.struct(
        "ordinal",
        F.struct("name", "dtype", "populated", "blank", "pii_type", "match_rate", "example").alias("c"),
    )
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"])
    return verdict.agg(
        F.lit(1).alias("schema_version"),
        F.lit(run_id).cast("string").alias("run_id"),
        F.coalesce(F.max(F.col("populated") + F.col("blank")), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        listed.alias("columns"),
    ).select(
        "schema_version",
        "run_id",
        "row_count",
        "column_count",
        F.transform(
            F.filter("columns", lambda c: c["pii_type"].isNotNull()), lambda c: c["name"]
        ).alias("pii_columns"),
        "columns",
    )


def rendered(document: DataFrame) -> str:
    """The verdict as JSON text; its length grows with the number of columns only."""
    return document.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")
    ).first()["j"]


def metadata_strings(df: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> list[str]:
    """Strings a verdict is meant to hold: column names, type names, labels, keys."""
    # The keys of a verdict.
    keys = [
        "schema_version", "run_id", "row_count", "column_count", "pii_columns", "columns",
        "name", "dtype", "populated", "blank", "pii_type", "match_rate", "example",
    ]
    types = ["bigint", "double", "boolean", "string"]
    return sorted({*df.columns, *keys, *types, *(d.pii_type for d in detectors)})


def exposed_values(df: DataFrame, output: str, allowed: list[str]) -> DataFrame:
    """Columns with a cell value inside ``output``: how many values, and how long.

    ``output`` is a small literal, so every cell is tested where it is read and only
    the (normally absent) hits are shuffled.
    """
    s = F.col("s")
    return (
        cells(df)
        .select("column", strip(F.col("value")).alias("s"))
        .where(F.length(s) >= MIN_COMPARED_LENGTH)
        .where(~s.isin(allowed))
        .where(F.contains(F.lit(output), s))
        .groupBy("column", "s").agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("values_exposed"),
            F.max(F.length("s")).cast("bigint").alias("longest"),
        )
    )


class ValueExposed(AssertionError):
    """An output held a cell value; the message names columns and lengths only."""


def assert_output_safe(df: DataFrame, output: str, allowed: list[str] | None = None) -> None:
    allow = metadata_strings(df) if allowed is None else allowed
    found = exposed_values(df, output, allow).collect()
    if found:
        where = ", ".join(f"{r['column']} ({r['longest']} chars)" for r in found)
        raise ValueExposed(f"output withheld: it repeats values of {where}")


def classify_csv(
    spark: SparkSession, path: str, run_id: str | None = None, multiline: bool = True
) -> DataFrame:
    """Classify a CSV file end to end, with the output checked against its own cells."""
    from cloakstone.sources.tables import read_text_csv

    table = read_text_csv(spark, path, multiline=multiline)
    document = verdict_document(classify(table), run_id)
    assert_output_safe(table, rendered(document))
    return document


def identifier_columns(verdict: DataFrame) -> tuple[list[str], list[str]]:
    """Names of (identifier, analysis) columns, in table order."""
    rows = verdict.select("ordinal", "name", "pii_type").collect()
    rows.sort(key=lambda r: r["ordinal"])
    return (
        [r["name"] for r in rows if r["pii_type"] is not None],
        [r["name"] for r in rows if r["pii_type"] is None],
    )
