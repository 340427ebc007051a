"""Incremental event merge and live scan over Structured Streaming.

The stream runs the first stage of the batch merge as a stateful aggregation keyed by
(message, block of sequence numbers): state per key is bounded by the block, a message
holding much of the log is spread over blocks, and redelivered events vanish in the set.
Each micro-batch appends the groups it changed to a table in shared storage, one folder per
batch that a retry overwrites.  The second stage folds the latest version of each block, so
stream and batch agree by construction.  Nothing is dropped when a thread is done: a
finished subagent's transcript is exactly what a later scan needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from cloakstone.functions.detectors import DEFAULT_PATTERNS, TextPattern
from cloakstone.functions.text import fingerprint
from cloakstone.operators.boundary import side_by_side
from cloakstone.operators.events import BLOCK, fold_blocks, gap_verdicts, join_blocks, normalised, visible_rows
from cloakstone.operators.scan import redact, scan_text
from cloakstone.operators.values import containment_pairs
from cloakstone.sources.session import at_folder

KEYS = ["session_id", "thread_id", "id"]
OnBatch = Callable[[DataFrame, int], None]


def latest_blocks(segments: DataFrame) -> DataFrame:
    """The newest version of every (message, block); earlier versions are prefixes of it."""
    newest = segments.groupBy(*KEYS, "block").agg(F.max("batch").alias("batch"))
    return segments.join(newest, [*KEYS, "block", "batch"], "left_semi").drop("batch")


def _snapshot(spark: SparkSession, table: str) -> int | None:
    """The last batch that a finished snapshot covers."""
    done: list[int] = []

    def look(files, target) -> None:
        found = files.globStatus(target)
        done.extend(int(f.getPath().getParent().getName().removeprefix("upto=")) for f in found or [])

    at_folder(spark, f"{table}/snapshots/*/_SUCCESS", look)
    return max(done, default=None)


def segments_of(spark: SparkSession, table: str) -> DataFrame:
    """Versions of every (message, block) with their batch: the last snapshot and the batches after it."""
    later = spark.read.parquet(f"{table}/segments")
    upto = _snapshot(spark, table)
    if upto is None:
        return later
    covered = spark.read.parquet(f"{table}/snapshots/upto={upto}").withColumn("batch", F.lit(upto))
    return later.where(F.col("batch") > upto).unionByName(covered)


def merged_view(spark: SparkSession, table: str) -> DataFrame:
    """All messages as merged so far."""
    return join_blocks(latest_blocks(segments_of(spark, table)))


def start_merge(
    events: DataFrame, table: str, checkpoint: str, on_batch: OnBatch | None = None,
    block: int = BLOCK, snapshot_every: int = 16, **trigger,
) -> StreamingQuery:
    """Keep the segments table current; hand ``on_batch`` the merged messages a batch touched.

    After every ``snapshot_every`` batches the latest versions are written as a snapshot, so a
    reader takes it and the few batches since, however long the stream has run.

    A value may be split over two deltas, two blocks or two batches, so every touched
    message is folded whole: all its blocks are looked up in the table.
    """

    def write(changed: DataFrame, number: int) -> None:
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(f"{table}/segments/batch={number}")
        if number and number % snapshot_every == 0:
            latest = latest_blocks(segments_of(spark, table).where(F.col("batch") <= number))
            latest.write.mode("overwrite").parquet(f"{table}/snapshots/upto={number}")
        if on_batch is None:
            return
        touched = spark.read.parquet(f"{table}/segments/batch={number}").select(*KEYS).distinct()
        history = segments_of(spark, table).where(F.col("batch") <= number)
        on_batch(join_blocks(latest_blocks(history.join(touched, KEYS, "left_semi"))), number)

    return (
        fold_blocks(normalised(events), block).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_live_scan(
    events: DataFrame, table: str, checkpoint: str, trace: bool = False,
    canaries: dict[str, str] | None = None, patterns: tuple[TextPattern, ...] = DEFAULT_PATTERNS,
    block: int = BLOCK, dictionary: DataFrame | None = None, **trigger,
) -> StreamingQuery:
    """Scan every message a batch touched; write hits, and optionally a redacted trace.

    ``dictionary`` (a ``value`` column) is compared with the text while it streams; its hits carry
    fingerprints.  The trace is redacted before it reaches any sink: it is shown while the turn
    runs, long before the final check.
    """

    def scan(merged: DataFrame, number: int) -> None:
        rows = visible_rows(merged).withColumn("text_id", F.concat_ws("/", *KEYS))
        seen = rows.select("text_id")
        found = scan_text(rows, "text_id", "text", canaries, patterns)
        found.write.mode("overwrite").parquet(f"{table}/hits/batch={number}")
        seen.write.mode("overwrite").parquet(f"{table}/scanned/batch={number}")
        if dictionary is not None:
            pairs = containment_pairs(rows, "text_id", "text", dictionary)
            pairs.select("text_id", fingerprint(F.col("value")).alias("fingerprint"), "occurrences").write.mode(
                "overwrite"
            ).parquet(f"{table}/values/batch={number}")
        if trace:
            shown = redact(rows.drop("text_id"), "text", canaries, patterns)
            shown.write.mode("overwrite").parquet(f"{table}/trace/batch={number}")

    return start_merge(events, table, checkpoint, scan, block, **trigger)


def live_hits(spark: SparkSession, table: str) -> DataFrame:
    """Hits of the stream.

    Pattern hits are those of the last scan of their message.  A planted value once seen is
    never withdrawn: if a later scan does not repeat it, the earlier hit stands.
    """
    hits = spark.read.parquet(f"{table}/hits")
    latest = spark.read.parquet(f"{table}/scanned").groupBy("text_id").agg(F.max("batch").alias("batch"))
    current = hits.join(latest, ["text_id", "batch"], "left_semi").drop("batch")
    last = hits.where("severity = 'canary'").groupBy("text_id", "label").agg(F.max("batch").alias("batch"))
    planted = hits.join(last, ["text_id", "label", "batch"], "left_semi").drop("batch")
    return current.where("severity <> 'canary'").unionByName(planted.where("severity = 'canary'"))


def live_values(spark: SparkSession, table: str) -> DataFrame:
    """Dictionary values seen in any scan of a message, with the most occurrences seen at once."""
    return spark.read.parquet(f"{table}/values").groupBy("text_id", "fingerprint").agg(
        F.max("occurrences").alias("occurrences")
    )


def stream_gaps(spark: SparkSession, table: str) -> DataFrame:
    """Per session: numbers missing between the first and the last event seen.

    Counted over distinct (session, number), because two messages may share one.
    """
    blocks = latest_blocks(segments_of(spark, table))
    numbers = blocks.select("session_id", F.explode_outer("seqs").alias("seq")).distinct()
    return gap_verdicts(
        numbers.groupBy("session_id").agg(
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.count("seq").alias("distinct_seqs"),
            F.count_if(F.col("session_id") == "").alias("malformed"),  # an unreadable line names no session
        )
    )


def stream_verdict(spark: SparkSession, table: str, dropped_rows: int) -> DataFrame:
    """One row: a scan that may have missed events fails, whatever it found.

    ``dropped_rows`` comes from :class:`LateRows`; 0 may be given only for a stream without watermark.
    """
    gaps = stream_gaps(spark, table).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(~F.col("complete")).alias("sessions_incomplete"),
    )
    found = live_hits(spark, table).agg(
        F.count_if(F.col("severity") == "canary").alias("canary_hits"),
        F.count_if(F.col("severity") == "pattern").alias("pattern_hits"),
    )
    complete = (F.col("sessions_incomplete") == 0) & F.lit(dropped_rows == 0)
    return side_by_side([gaps, found]).withColumns(
        {"complete": complete, "passed": complete & (F.col("canary_hits") == 0)}
    )


class LateRows(StreamingQueryListener):
    """Counts the rows a watermark discarded over the whole run of every query it listens to.

    Progress reports kept by a query are only the last ones, so they are counted as they come.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(int(state.numRowsDroppedByWatermark) for state in event.progress.stateOperators)
        key = str(event.progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self.dropped[str(query.id)]


def deduplicated(events: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Redelivered events removed while streaming, for sinks that cannot absorb copies."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["session_id", "seq"])
