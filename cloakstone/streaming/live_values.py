"""Known values found while a stream runs, each part of a text compared once.

Per message and channel a keyed store (:mod:`cloakstone.streaming.store`) remembers how many characters were
compared and their hash.  When a batch touches a message, its text is compared from one character less than the longest value
before that place on, so a value cut by deltas, blocks or batches is found with the part that
completes it, and nothing else is read again by the kernel.  A text that no longer begins with what was
compared (an event came late and was put before it) is compared from its start.

The filter of the dictionary is built once, when the stream starts.  A pair once found stays found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakstone.functions.text import fingerprint
from cloakstone.operators.events import BLOCK, VISIBLE_TYPES
from cloakstone.operators.values import GRAM, build_filter, candidates, settle
from cloakstone.sources.session import discard, keep
from cloakstone.streaming.store import MESSAGE, Store
from cloakstone.streaming.turns import start_turns

CHANNEL = [*MESSAGE, "channel"]
SCANNED = "array<struct<channel:string,n:bigint,hash:bigint>>"


def channels(merged: DataFrame, visible_types: tuple[str, ...] = VISIBLE_TYPES) -> DataFrame:
    """One row per visible text of a message: its content, its reasoning, the arguments of each call."""

    def channel(name, text):
        return F.struct(name.alias("channel"), F.make_valid_utf8(F.coalesce(text, F.lit(""))).alias("text"))

    calls = F.transform(
        "tool_calls", lambda c: channel(F.concat(F.lit("call:"), F.coalesce(c["id"], F.lit(""))), c["function"]["arguments"])
    )
    none = F.array().cast("array<struct<channel:string,text:string>>")
    listed = F.concat(
        F.array(channel(F.lit("text"), F.col("text")), channel(F.lit("reasoning"), F.col("reasoning"))), F.coalesce(calls, none)
    )
    rows = merged.where(F.col("type").isin(*visible_types)).select(*MESSAGE, F.explode(listed).alias("c"))
    return rows.select(*MESSAGE, "c.channel", "c.text").where("text <> ''")


def start_live_values(
    events: DataFrame, path: str, checkpoint: str, dictionary: DataFrame, block: int = BLOCK, shortest: int = GRAM,
    buckets: int = 16, **options,
) -> StreamingQuery:
    """Compare a stream's visible text with ``dictionary`` (a ``value`` column, kept for the stream's run; copies do no harm)."""
    spark = events.sparkSession
    values = keep(dictionary.where(F.length("value") >= shortest).select("value"), "live-dictionary")
    filtered = build_filter(values, shortest=shortest)
    scanned = Store(spark, f"{path}/scanned", buckets)

    def compare(merged: DataFrame, number: int) -> None:
        rows = keep(channels(merged), "touched")
        known = scanned.lookup(rows, number - 1).select(
            *MESSAGE, F.explode(F.from_json("rows", SCANNED)).alias("k")
        ).select(*MESSAGE, "k.*")
        joined = rows.join(known, CHANNEL, "left")
        grown = F.coalesce(F.xxhash64(F.substring("text", F.lit(1), F.col("n").cast("int"))) == F.col("hash"), F.lit(False))
        start = F.when(grown, F.greatest(F.lit(0), F.col("n") - filtered.longest + 1)).otherwise(0).cast("int")
        part = F.substring("text", start + 1, F.length("text"))
        news = joined.where(~grown | (F.length("text") > F.col("n")))
        texts = news.select(F.concat_ws("/", *MESSAGE).alias("text_id"), part.alias("text"))
        found = settle(keep(candidates(texts, filtered, "text_id"), "survivors"), "text_id", values)
        pairs = found.select("text_id", fingerprint(F.col("value")).alias("fingerprint")).distinct()
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")
        news.agg(F.coalesce(F.sum(F.length(part)), F.lit(0)).alias("chars")).write.mode("overwrite").json(f"{path}/read/batch={number}")
        state = F.struct("channel", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("hash"))
        versions = rows.groupBy(*MESSAGE).agg(F.to_json(F.sort_array(F.collect_list(state))).alias("rows")).select(
            *MESSAGE, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("life"), "rows"
        )
        scanned.write(versions, number)
        discard(rows)

    return start_turns(events, f"{path}/table", checkpoint, block=block, on_batch=compare, **options)


def found_values(spark: SparkSession, path: str) -> DataFrame:
    """Every (text, fingerprint) found so far."""
    return spark.read.schema("text_id string, fingerprint string, batch long").parquet(f"{path}/pairs").select("text_id", "fingerprint").distinct()


def characters_read(spark: SparkSession, path: str) -> DataFrame:
    """Characters handed to the kernel, per batch."""
    return spark.read.schema("chars long, batch long").json(f"{path}/read")
