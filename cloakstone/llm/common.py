"""Expressions and small distributed helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakstone.sources.session import keep

# Blank characters and word shape of the contracts.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only (52 bits of MD5); null is a key."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def blocks(df: DataFrame, *order: str) -> DataFrame:
    """Sort-range partitions of ``df`` with their number as ``block``, settled in the shared folder.

    Blocks follow the order of the columns ``order`` from one to the next, so a global
    running value is one inside the block plus one carried over the few blocks before it:
    no window spans the whole table.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
    return keep(ranged.withColumn("block", F.spark_partition_id()), "blocks")


def carried(per_block: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over all earlier blocks; ``per_block`` has one row per partition of the shuffle."""
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select("block", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("carry"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Position (from 0) of each row in the global order, nulls last, as ``position``."""
    blocked = blocks(df, *order)
    counts = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("block").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        blocked.withColumn("inner", F.row_number().over(inside) - 1)
        .join(carried(counts, "rows"), "block")
        .withColumn("position", F.col("carry") + F.col("inner"))
        .drop("block", "inner", "carry")
    )
