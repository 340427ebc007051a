"""The planted side record and the list of suspected values: small documents, strictly read."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CanaryError(ValueError):
    """The record cannot be used; the message never quotes it."""


@dataclass(frozen=True)
class Canary:
    ssn: str
    name: str
    row_index: int = -1
    subject_id: str = "unknown"
    run_id: str | None = None

    def values(self) -> dict[str, str]:
        return {"ssn": self.ssn, "name": self.name}


def parse_canary(text: str, run_id: str | None = None) -> Canary:
    """Read the record or raise: an empty or non-text value would match nothing and pass.

    With ``run_id`` given, a record of another run is refused too.
    """
    try:
        record = json.loads(text)
    except ValueError:
        raise CanaryError("canary record is not valid JSON") from None
    usable = isinstance(record, dict) and all(
        isinstance(record.get(k), str) and record[k] for k in ("ssn", "name")
    )
    if not usable:
        raise CanaryError("canary record needs non-empty string ssn and name")
    if run_id is not None and record.get("run_id") != run_id:
        raise CanaryError("canary record belongs to another run")
    index, subject, run = (record.get(k) for k in ("row_index", "subject_id", "run_id"))
    return Canary(
        ssn=record["ssn"],
        name=record["name"],
        row_index=index if isinstance(index, int) and not isinstance(index, bool) else -1,
        subject_id=subject if isinstance(subject, str) and subject else "unknown",
        run_id=run if isinstance(run, str) else None,
    )


def read_canary(spark: SparkSession, path: str, run_id: str | None = None) -> Canary:
    """Read the side record from any file system Spark reaches."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise CanaryError("expected exactly one canary record")
    return parse_canary(rows[0]["value"], run_id)


def read_candidates(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Suspected values from JSON arrays of strings; anything else in the file is an error.

    A file holds one array, or, with ``lines``, one a line: such files are read in splits, so neither one
    task nor one cell holds a whole list.
    """
    parsed = spark.read.text(path, wholetext=not lines).select(
        F.try_parse_json("value").alias("v")
    ).select("v", F.schema_of_variant("v").alias("kind"))
    listed = parsed.select(
        F.when(
            F.col("kind").startswith("ARRAY"), F.try_variant_get("v", "$", "array<string>")
        ).otherwise(
            F.raise_error(F.lit("the candidate file must hold a JSON array of strings")).cast(
                "array<string>"
            )
        ).alias("values")
    )
    return listed.select(F.explode("values").alias("candidate")).where("candidate <> ''").distinct()
