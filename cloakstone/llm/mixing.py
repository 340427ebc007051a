"""Mix sources to target weights by repetition.

Each source gets a target of words.  Its rate is target / size; every document is emitted
floor(rate) times, plus once more when a number drawn from the hash of its id and a seed falls
below the fraction of the rate.  Reruns and retries therefore agree, and no document depends on
another.

Targets: sources sorted by code point (null last) weigh 5, 2, 1, repeating, and share
``share`` times all words.  A target stops at ``cap`` times its source's size; what is over is
shared again by weight until none is above.  The loop runs on sums over the table of sources,
which stays distributed.

Cases: a null text has size 0 and takes nothing.  A source without words has target 0 and rate
0.  Repeated rows (one id) draw alike and are emitted alike.  A null id draws as the text
``null``.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakstone.llm.common import numbered, uniform, word_count
from cloakstone.sources.session import keep

WEIGHTS = (5, 2, 1)


def source_targets(
    sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, target."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(per_source, "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights)).cast("int") + 1)
    ranked = keep(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.lit(cap) * F.col("source_size")
    level, full = 0.0, -1
    while True:
        over = limit < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open_weight"),
            F.count_if(over).alias("full"),
        ).first()
        if row["full"] == full or not row["open_weight"]:
            break
        full = row["full"]
        level = (share * row["total"] - cap * row["held"]) / row["open_weight"]
    return ranked.select(
        "source", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target")
    )


def mix_plan(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """Copies of every document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    aimed = source_targets(sizes, **targets).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return (
        sizes.join(aimed, sizes["source"].eqNullSafe(aimed["__source"]))
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix(docs: DataFrame, seed: str = "mix", copy_column: str = "copy", **targets) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, its copies numbered from 0.

    If ``docs`` has a column named like ``copy_column``, the new one gets an underscore more.
    """
    while copy_column in docs.columns:
        copy_column += "_"
    sized = docs.withColumn("__size", word_count(F.col("text")))
    aimed = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), **targets)
    aimed = aimed.select(
        F.col("source").alias("__source"), F.col("source_size").alias("__total"), F.col("target").alias("__target")
    )
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0)
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    numbers = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return sized.join(aimed, sized["source"].eqNullSafe(aimed["__source"])).select(
        *[sized[c] for c in docs.columns], F.explode(numbers).alias(copy_column)
    )
