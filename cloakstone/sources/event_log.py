"""Event logs: the schema, batch and streaming readers.

Transports spell fields in snake or camel case and number events as numbers or text; readers
return one spelling and bigint numbers.  A line that is not an event is not dropped: it comes
back with ``malformed`` set, and the sequence check calls its log incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FUNCTION = "function:struct<name:string,arguments:string>"
# ``content`` is a VARIANT, so the text "42" and the number 42 stay apart.
EVENT_SCHEMA = (
    "session_id string, sessionId string, seq string, id string, type string, thread_id string, threadId string, "
    "content variant, reasoning_content string, reasoningContent string, "
    f"tool_calls array<struct<id:string,source_event_id:string,sourceEventId:string,{_FUNCTION}>>, "
    f"toolCalls array<struct<id:string,source_event_id:string,sourceEventId:string,{_FUNCTION}>>, "
    "turn_id string, turnId string, sandbox_id string, sandboxId string, "
    "approval struct<status:string,reason:string>, _unreadable string"
)


def parse_sequence(value: Column) -> Column:
    """A transport's event number as bigint; null when it is missing or not a finite number."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9.0e18))
    return F.coalesce(value.try_cast("bigint"), F.when(finite, number.cast("bigint")))


def unified(raw: DataFrame) -> DataFrame:
    """Lines of :data:`EVENT_SCHEMA` with one spelling per field, and ``malformed``."""

    def calls(name: str) -> Column:
        return F.transform(
            name,
            lambda c: F.struct(
                c["id"].alias("id"),
                F.coalesce(c["source_event_id"], c["sourceEventId"]).alias("source_event_id"),
                c["function"].alias("function"),
            ),
        )

    return raw.select(
        F.coalesce("session_id", "sessionId").alias("session_id"),
        parse_sequence(F.col("seq")).alias("seq"),
        "id",
        "type",
        F.coalesce("thread_id", "threadId").alias("thread_id"),
        "content",
        F.concat_ws("\n", "reasoning_content", "reasoningContent").alias("reasoning_content"),
        F.coalesce(calls("toolCalls"), calls("tool_calls")).alias("tool_calls"),
        F.coalesce("turn_id", "turnId").alias("turn_id"),
        F.coalesce("sandbox_id", "sandboxId").alias("sandbox_id"),
        "approval",
        (F.col("_unreadable").isNotNull() | F.col("type").isNull()).alias("malformed"),
    )


def read_event_log(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Newline-delimited JSON events; a session filter prunes a log partitioned by session."""
    raw = spark.read.schema(EVENT_SCHEMA).option("columnNameOfCorruptRecord", "_unreadable").json(path)
    if session_id is not None:
        here = (F.col("session_id") == session_id) | (F.col("session_id").isNull() & (F.col("sessionId") == session_id))
        raw = raw.where(here)
    return unified(raw)


def stream_event_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("columnNameOfCorruptRecord", "_unreadable")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return unified(reader.json(path))
