"""Plant a record in a table, so that a leak check has something to hunt for."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakstone.functions.text import strip
from cloakstone.sources.canary import Canary

_OPEN, _CORE, _SHUT = "b br c d dr f g h k l m n p r s t th v w".split(), "a e i o u ae ea".split(), "l m n r s th".split()


def invented_name() -> str:
    """Two invented words from the system's random source, some hundred million of them each."""

    def word() -> str:
        parts = [secrets.choice(_OPEN) + secrets.choice(_CORE) for _ in range(3)]
        return ("".join(parts) + secrets.choice(_SHUT)).capitalize()

    return f"{word()} {word()}"


def mint_canary(table: DataFrame, tries: int = 32) -> Canary:
    """A random record whose values no row holds.

    Drawn from the system's random source.  The table is filtered by ``tries`` candidates, so no
    more values come back; if rows hold all of them, the numbers are taken and it raises.
    """
    numbers = [f"9{secrets.randbelow(100):02d}-{secrets.randbelow(100):02d}-{secrets.randbelow(10000):04d}" for _ in range(tries)]
    names = [invented_name() for _ in range(tries)]
    ssn, name = strip(F.col("ssn")), F.lower(strip(F.col("patient_name")))
    taken = table.agg(
        F.collect_set(F.when(ssn.isin(numbers), ssn)).alias("numbers"),
        F.collect_set(F.when(name.isin([n.lower() for n in names]), name)).alias("names"),
    ).first()
    free = [n for n in numbers if n not in taken["numbers"]], [n for n in names if n.lower() not in taken["names"]]
    if not all(free):
        raise ValueError("every candidate is taken: the table leaves no number to plant")
    return Canary(ssn=free[0][0], name=free[1][0])


def interior_row(rows: int) -> int:
    """A random row to plant in: never the first or last, both of which a glance shows."""
    if rows < 3:
        raise ValueError("at least 3 rows are needed to keep the planted row interior")
    return 1 + secrets.randbelow(rows - 2)


def plant(table: DataFrame, index_column: str, index: int, canary: Canary) -> DataFrame:
    """Write the record verbatim into the row with this index."""
    here = F.col(index_column) == index
    return table.withColumns(
        {
            "patient_name": F.when(here, canary.name).otherwise(F.col("patient_name")),
            "ssn": F.when(here, canary.ssn).otherwise(F.col("ssn")),
        }
    )


def planted_counts(table: DataFrame, canary: Canary) -> DataFrame:
    return table.agg(
        F.count_if(F.col("ssn") == canary.ssn).alias("ssn_rows"),
        F.count_if(F.col("patient_name") == canary.name).alias("name_rows"),
    )


def assert_planted_once(table: DataFrame, canary: Canary) -> None:
    """A leak proof hunting for a record that is not there would pass for nothing."""
    row = planted_counts(table, canary).first()
    if (row["ssn_rows"], row["name_rows"]) != (1, 1):
        raise AssertionError("the planted record is not in the table exactly once")
