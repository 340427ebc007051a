"""Event merge with state that ends: ``transformWithState`` keyed by (session, block of numbers).

A group holds the rows of the messages whose numbers lie in its block, so neither a long session nor a hot
message sits in one group.  The end of a turn (``turn.done``) is dealt to every block up to its own and
sets an event-time timer there: when the watermark has passed it by ``delay``, messages whose last number lies before
the end leave the state.  The end of a thread never does that, because a finished subagent's transcript is what
a later scan needs.  A group without any event for ``idle`` ends as well, so a session that breaks off does not stay.
Evicted messages stay in the table (:mod:`cloakstone.streaming.store`); one that is continued later begins a
new life there, and readers fold all its lives together with the batch code.

Rows older than the watermark are dropped by Spark before they reach the state.  The query observes how many rows
arrive; the state reports how many it took; :class:`Ledger` keeps both per batch, and
:func:`verdict` calls a stream incomplete when they differ or a batch is not accounted for.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from cloakstone.functions.text import whole
from cloakstone.operators.boundary import side_by_side
from cloakstone.operators.events import BLOCK, UNNUMBERED, fold_blocks, gap_verdicts, join_blocks, normalised
from cloakstone.sources.session import at_folder
from cloakstone.streaming.store import MESSAGE, VERSION, Store

TURN_DONE = "turn.done"
ROW = (
    "seq bigint, is_delta boolean, type string, text string, reasoning string, "
    "tool_calls array<struct<id:string,source_event_id:string,function:struct<name:string,arguments:string>>>, plain boolean"
)
OUT = "kind string, session_id string, block long, thread_id string, id string, life long, rows string, n long"
OnBatch = Callable[[DataFrame, int], None]


class Turns(StatefulProcessor):
    """Rows of the messages of one (session, block), until their turn is over."""

    def __init__(self, delay_ms: int, idle_ms: int) -> None:
        self.delay, self.idle = delay_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = "thread_id string, id string"
        self.rows = handle.getMapState("rows", key, "rows string")
        # What eviction needs, apart from the texts: last number (-1 without any), last time, life.
        self.last = handle.getMapState("last", key, "seq long, at long, life long")
        self.ends = handle.getMapState("ends", "due long", "seq long, at long")
        self.quiet = handle.getValueState("quiet", "due long")

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        named = [(kind, *key, *rest) for kind, *rest in rows]
        return pd.DataFrame(named, columns=[part.split()[0] for part in OUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple[str, str], list[tuple[str, int, int]]] = {}
        ends: dict[int, tuple[int, int]] = {}
        taken = latest = 0
        for batch in rows:
            columns = ("kind", "thread_id", "id", "number", "at_ms", "row")
            for kind, thread, name, seq, at, row in batch[[*columns]].itertuples(index=False, name=None):
                latest = max(latest, at)
                if kind == "end":
                    ends[at + self.delay] = max(ends.get(at + self.delay, (-1, 0)), (seq, at))
                else:
                    taken += 1
                    fresh.setdefault((thread, name), []).append((row, seq, at))
        out = [("taken", "", "", 0, "", taken)]
        for message, new in fresh.items():
            if self.last.containsKey(message):
                (held,), (seq, at, life) = self.rows.getValue(message), self.last.getValue(message)
                lines = held.split("\n")
            else:
                lines, seq, at, life = [], -1, 0, timerValues.getCurrentWatermarkInMs()
            # A redelivered row is the same line; without a number nothing tells it from an equal one.
            lines = [*lines, *(row for row, _, _ in new)]
            text = "\n".join(lines if key[1] == UNNUMBERED else dict.fromkeys(lines))
            self.rows.updateValue(message, (text,))
            self.last.updateValue(message, (max(seq, *[n for _, n, _ in new]), max(at, *[t for _, _, t in new]), life))
            out.append(("rows", *message, life, text, len(new)))
        for due, end in ends.items():
            if not self.ends.containsKey((due,)) or self.ends.getValue((due,)) < end:
                self.ends.updateValue((due,), end)
            self.handle.registerTimer(due)
        self._wait(latest)
        yield self._out(key, out)

    def _wait(self, latest: int) -> None:
        due = latest + self.idle
        if self.quiet.exists():
            (before,) = self.quiet.get()
            if before >= due:
                return
            if not self.ends.exists() or not self.ends.containsKey((before,)):
                self.handle.deleteTimer(before)
        self.quiet.update((due,))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        is_quiet = self.quiet.exists() and self.quiet.get() == (due,)
        end = None
        if self.ends.exists() and self.ends.containsKey((due,)):
            end = self.ends.getValue((due,))
            self.ends.removeKey((due,))
        out, left = [], 0
        for message, (seq, at, life) in list(self.last.iterator()) if self.last.exists() else []:
            over = end is not None and (seq <= end[0] if seq >= 0 else at <= end[1])
            if is_quiet or over:
                self.rows.removeKey(message)
                self.last.removeKey(message)
                out.append(("evicted", *message, life, "", 1))
            else:
                left += 1
        if is_quiet or (not left and not (self.ends.exists() and list(self.ends.keys()))):
            if self.quiet.exists():
                if not is_quiet:
                    self.handle.deleteTimer(self.quiet.get()[0])
                self.quiet.clear()
        yield self._out(key, out)

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, span: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {span})").first()[0]


def arrivals_name(path: str) -> str:
    return "arrived_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:12]


def start_turns(
    events: DataFrame, path: str, checkpoint: str, event_time: str = "at", lateness: str = "10 minutes",
    delay: str = "1 hour", idle: str = "7 days", block: int = BLOCK, on_batch: OnBatch | None = None,
    store: Store | None = None, **trigger,
) -> StreamingQuery:
    """Merge a stream into the store at ``path``; hand ``on_batch`` the whole messages a batch touched.

    ``lateness`` is how far events may come behind the newest one; ``delay`` how long state outlives its turn.
    """
    spark = events.sparkSession
    store = store or Store(spark, path)
    timed = events.observe(arrivals_name(path), F.count(F.lit(1)).alias("rows")).withWatermark(event_time, lateness)
    own = F.coalesce(whole(F.col("seq"), block), F.lit(UNNUMBERED))
    target = F.struct(F.lit("row").alias("kind"), own.alias("block"))

    def ending(b: Column) -> Column:
        return F.struct(F.lit("end").alias("kind"), b.cast("long").alias("block"))

    # An end goes to every block up to its own, and to the rows without a number.
    earlier = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(own, F.lit(0))), ending)
    targets = F.when(
        (F.col("type") == TURN_DONE) & F.col("seq").isNotNull(),
        F.concat(F.array(target), earlier, F.array(ending(F.lit(UNNUMBERED)))),
    ).otherwise(F.array(target))
    names = [part.split()[0] for part in ROW.split(", ")[:6]] + ["plain"]
    dealt = (
        normalised(timed, event_time).withColumn("target", F.explode(targets))
        .select(
            event_time, "session_id", "target.block", "target.kind", "thread_id", "id",
            F.coalesce("seq", F.lit(-1)).alias("number"), F.coalesce(F.unix_millis(event_time), F.lit(0)).alias("at_ms"),
            F.when(F.col("target.kind") == "row", F.to_json(F.struct(*names))).otherwise("").alias("row"),
        )
    )
    kept = dealt.groupBy("session_id", "block").transformWithStateInPandas(
        Turns(_milliseconds(spark, delay), _milliseconds(spark, idle)), OUT, "Update", "EventTime"
    )

    def write(out: DataFrame, number: int) -> None:
        folder = f"{path}/batches/batch={number}"
        out.write.mode("overwrite").partitionBy("kind").parquet(folder)  # the state must be asked once only
        written = out.sparkSession.read.schema(OUT).parquet(folder)
        changed = written.where("kind = 'rows'").select(*VERSION, "rows")
        store.write(changed, number, written.where("kind = 'evicted'").select(*VERSION))
        if on_batch is not None:
            on_batch(folded(store.lookup(changed, number), block), number)
        at_folder(spark, f"{folder}/kind=rows", lambda files, target: files.delete(target, True))

    return (
        kept.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def raw_rows(versions: DataFrame) -> DataFrame:
    """The distinct normalised rows of versions; several lives of a message are simply put together."""
    lines = versions.select(*MESSAGE, "block", "life", F.explode(F.split("rows", "\n")).alias("line"))
    parsed = lines.select(*MESSAGE, "life", "line", F.from_json("line", ROW).alias("r"))
    # Copies of a numbered row collapse when blocks are folded.
    return parsed.select(*MESSAGE, "r.*")


def folded(versions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Merged messages of versions, by the batch code."""
    empty = F.coalesce("reasoning", F.lit(""))
    rows = raw_rows(versions).withColumns({"reasoning": empty, "text": F.coalesce("text", F.lit(""))})
    return join_blocks(fold_blocks(rows, block))


def merged_messages(store: Store, block: int = BLOCK) -> DataFrame:
    """All messages as merged so far, evicted ones included."""
    return folded(store.versions(), block)


def evicted(spark: SparkSession, path: str) -> DataFrame:
    """What left the state: (message, block, life) and the batch."""
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", f"{path}/batches").parquet(f"{path}/batches/*")
    return rows.where("kind = 'evicted'").select(*VERSION, "batch")


def stored_gaps(store: Store) -> DataFrame:
    """Per session: numbers missing between the first and the last row in the store."""
    numbers = raw_rows(store.versions()).select("session_id", "seq").distinct()
    return gap_verdicts(
        numbers.groupBy("session_id").agg(
            F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("seq").alias("distinct_seqs"),
            F.count_if(F.col("session_id") == "").alias("malformed"),
        )
    )


class Ledger(StreamingQueryListener):
    """Writes down, per batch, how many rows arrived and how many the watermark dropped."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path, self._name = spark, path.rstrip("/"), arrivals_name(path)
        self._written: set[int] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self._name)
        if seen is None:
            return
        dropped = sum(int(state.numRowsDroppedByWatermark) for state in event.progress.stateOperators)
        line = json.dumps({"batch": event.progress.batchId, "arrived": seen["rows"], "dropped": dropped})

        def put(files, target) -> None:
            out = files.create(target, True)
            out.write(bytearray((line + "\n").encode()))
            out.close()

        at_folder(self._spark, f"{self._path}/ledger/{event.progress.batchId}.json", put)
        self._written.add(event.progress.batchId)

    def wait(self, batch: int, seconds: float = 30) -> None:
        """Reports come a little after their batch; one that never comes leaves its batch unaccounted for."""
        until = time.monotonic() + seconds
        while batch not in self._written and time.monotonic() < until:
            time.sleep(0.05)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ledger(spark: SparkSession, path: str, last_batch: int) -> DataFrame:
    """Per batch up to ``last_batch``: rows arrived, taken into the state, and late; null where nothing was written down."""
    seen = spark.read.schema("batch long, arrived long, dropped long").json(f"{path}/ledger")
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", f"{path}/batches").parquet(f"{path}/batches/*")
    taken = rows.where("kind = 'taken'").groupBy("batch").agg(F.sum("n").alias("taken"))
    return (
        spark.range(last_batch + 1).withColumnRenamed("id", "batch").join(seen, "batch", "left").join(taken, "batch", "left")
        .select("batch", "arrived", F.coalesce("taken", F.lit(0)).alias("taken"), (F.col("arrived") - F.coalesce("taken", F.lit(0))).alias("late"))
    )


def verdict(store: Store) -> DataFrame:
    """One row: did the stream see everything?  Late rows, unaccounted batches and gaps each fail it."""
    spark, path = store.spark, store.path
    counted = ledger(spark, path, store.manifest()["batch"]).agg(
        F.coalesce(F.sum("arrived"), F.lit(0)).alias("arrived"), F.sum("taken").alias("taken"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"), F.count_if(F.col("arrived").isNull()).alias("unaccounted"),
    )
    gaps = stored_gaps(store).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(~F.col("complete")).alias("sessions_incomplete")
    )
    complete = (F.col("late") == 0) & (F.col("unaccounted") == 0) & (F.col("sessions_incomplete") == 0)
    return side_by_side([counted, gaps]).withColumn("passed", complete)
