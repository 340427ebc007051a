"""Live trace: what a model writes, shown while it writes, and masked before it reaches any sink.

A value may be cut anywhere by the deltas that carry it.  Per message and channel (text, reasoning, the
arguments of one call) the state holds back the longest end of the text that may still become a planted
value or an identifier shape, and the few characters before it that a shape looks at; all else is masked and
released at once.  So no part of a value leaves before it is known to be none, every character is
released once, and only what is held back is looked at again.  What is held is bounded by the longest
match.  When a message has been quiet for ``patience`` of event time, the rest is masked and released and
its state goes.

The pieces of a message, put together, are the text masked whole: the batch operator
(:func:`cloakstone.operators.scan.redact`) gives the same.  Events are shown in order of arrival, by number
within a batch.  One that is not newer than what was shown is a copy or came too late to be shown in its place: it is
counted as skipped, and the merged table has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cloakstone.functions.detectors import DEFAULT_PATTERNS, TextPattern
from cloakstone.operators.events import normalised

KEY = ["session_id", "thread_id", "id", "channel"]
OUT = "session_id string, thread_id string, id string, channel string, ordinal int, text string, skipped long"
GROUPS = 1024  # of channels that share a state call
CONTEXT = 8  # characters before a match that a shape may look at


def widest(pattern: str) -> int:
    """The most characters a pattern can match; every quantifier of a text pattern is bounded."""
    width = re._parser.parse(pattern).getwidth()[1]
    if width > 1 << 16:
        raise ValueError(f"a pattern without bound cannot be masked while streaming: {pattern}")
    return width


class Masker:
    """Masks a text that comes in pieces."""

    def __init__(self, canaries: dict[str, str], patterns: tuple[TextPattern, ...]) -> None:
        self.planted = [(v, f"[canary:{k}:redacted]") for k, v in canaries.items() if v]
        self.shapes = [(re.compile(p.regex), regex.compile(p.regex), widest(p.regex), p.placeholder) for p in patterns]

    def _open(self, text: str, start: int) -> int:
        """Where the longest end of ``text`` begins that more text may turn into a match or a longer one."""
        size = len(text)
        first = size
        for value, _ in self.planted:
            for length in range(min(len(value) - 1, size - start), size - first, -1):
                if text.endswith(value[:length]):
                    first = size - length
                    break
        for _, partly, width, _ in self.shapes:
            at = max(start, size - width)
            while at < first and (m := partly.search(text, at, partial=True)):
                # A match may still become longer: then its whole end is open.
                if m.partial or partly.fullmatch(text, m.start(), partial=True):
                    first = min(first, m.start())
                    break
                at = max(m.end(), at + 1)
        return first

    def _cut(self, text: str, start: int) -> int:
        """As far as ``text`` can be released: no match reaches over the cut."""
        cut = self._open(text, start)
        moved = True
        while moved and cut < len(text):
            moved = False
            for value, _ in self.planted:
                at = text.find(value, max(start, cut - len(value) + 1), cut + len(value) - 1)
                if start <= at < cut < at + len(value):
                    cut, moved = at, True
            for whole, _, width, _ in self.shapes:
                for m in whole.finditer(text, max(start, cut - 2 * width)):
                    if m.start() >= cut:
                        break
                    if m.end() > cut:
                        cut, moved = m.start(), True
        return cut

    def mask(self, before: str, body: str) -> str:
        """``body`` masked, as it stands behind ``before``."""
        for value, placeholder in self.planted:
            body = body.replace(value, placeholder)
        for whole, _, _, placeholder in self.shapes:
            text, parts, here = before + body, [], len(before)
            for m in whole.finditer(text, len(before)):
                parts += [text[here : m.start()], placeholder]
                here = m.end()
            if parts:
                body = "".join([*parts, text[here:]])
        return body

    def feed(self, before: str, held: str, more: str) -> tuple[str, str, str]:
        """What can be released of ``held + more``, and the new context and rest."""
        text = before + held + more
        cut = self._cut(text, len(before))
        return self.mask(before, text[len(before) : cut]), text[max(0, cut - CONTEXT) : cut], text[cut:]


class Trace(StatefulProcessor):
    """The open channels of one group of messages.

    A state call and a frame cost far more than masking a piece, so a group is asked and answered at once.  Its
    one timer stands at the earliest end of its channels, or before it.
    """

    def __init__(self, canaries: dict[str, str], patterns: tuple[TextPattern, ...], patience_ms: int) -> None:
        self.given, self.patience = (canaries, patterns), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.masker = Masker(*self.given)
        self.open = handle.getMapState("open", ", ".join(f"{k} string" for k in KEY), "before string, held string, seq long, due long")
        self.group = handle.getValueState("group", "due long, n long")

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[at : at + 10_000], columns=[part.split()[0] for part in OUT.split(", ")])

    def _held(self, keys: list[tuple], n: int) -> dict[tuple, tuple]:
        """State of the given channels; read in one go where they are a good part of the group."""
        if not n:
            return {}
        if len(keys) * 16 >= n:
            return {tuple(key): tuple(value) for key, value in self.open.iterator()}
        found = {key: self.open.getValue(key) for key in keys}
        return {key: tuple(value) for key, value in found.items() if value is not None}

    def _wait(self, before: int, due: int, n: int) -> None:
        if before and before != due:
            self.handle.deleteTimer(before)
        if before != due:
            self.handle.registerTimer(due)
        self.group.update((due, n))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple, list[tuple]] = {}
        for batch in rows:
            for *channel, number, piece, at in batch[[*KEY, "number", "piece", "at_ms"]].itertuples(index=False, name=None):
                fresh.setdefault(tuple(channel), []).append((number, piece, at))
        timer, n = self.group.get() if self.group.exists() else (0, 0)
        known, out, first = self._held(list(fresh), n), [], timer
        for channel, arrived in fresh.items():
            before, held, seq, due = known.get(channel, ("", "", -1, 0))
            shown, skipped, latest = [], 0, 0
            for number, piece, at in sorted(arrived):
                latest = max(latest, at)
                if 0 <= number <= seq:
                    skipped += 1
                    continue
                seq = max(seq, number)
                part, before, held = self.masker.feed(before, held, piece)
                shown.append(part)
            due = max(due, latest + self.patience)
            first = min(first or due, due)
            n += channel not in known
            self.open.updateValue(channel, (before, held, seq, due))
            out.append((*channel, 0, "".join(shown), skipped))
        self._wait(timer, first, n)
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out, left = [], []
        for channel, (before, held, _, due) in list(self.open.iterator()):
            if due > now:
                left.append(due)
            else:
                out.append((*channel, 1, self.masker.mask(before, held), 0))
        if left:
            for row in out:
                self.open.removeKey(row[: len(KEY)])
            self._wait(0, min(left), len(left))  # the timer that fired is gone
        else:
            self.open.clear()
            self.group.clear()
        yield from self._out(out)

    def close(self) -> None:
        pass


def start_trace(
    events: DataFrame, path: str, checkpoint: str, canaries: dict[str, str] | None = None,
    patterns: tuple[TextPattern, ...] = DEFAULT_PATTERNS, event_time: str = "at", lateness: str = "10 minutes",
    patience: str = "1 hour", groups: int = GROUPS, **trigger,
) -> StreamingQuery:
    """Write the masked trace of a stream to ``path``, one folder a batch, which a repeated batch overwrites.

    ``groups`` is how many groups the channels are dealt to; it stays as it is for a checkpoint.
    """
    spark = events.sparkSession
    (quiet,) = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {patience})").first()

    def channel(name, text):
        return F.struct(name.alias("channel"), F.coalesce(text, F.lit("")).alias("piece"))

    calls = F.transform(
        "tool_calls", lambda c: channel(F.concat(F.lit("call:"), F.coalesce(c["id"], F.lit(""))), c["function"]["arguments"])
    )
    plain = F.array(channel(F.lit("text"), F.col("text")), channel(F.lit("reasoning"), F.col("reasoning")))
    pieces = F.filter(F.concat(plain, F.coalesce(calls, F.array().cast("array<struct<channel:string,piece:string>>"))), lambda c: c["piece"] != "")
    rows = normalised(events.withWatermark(event_time, lateness), event_time).withColumn("c", F.explode(pieces)).select(
        event_time, "session_id", "thread_id", "id", "c.channel", F.make_valid_utf8("c.piece").alias("piece"),
        F.coalesce("seq", F.lit(-1)).alias("number"), F.coalesce(F.unix_millis(event_time), F.lit(0)).alias("at_ms"),
    )
    shown = rows.withColumn("group", F.pmod(F.xxhash64(*KEY), F.lit(groups)).cast("int")).groupBy("group").transformWithStateInPandas(Trace(canaries or {}, patterns, quiet), OUT, "Update", "EventTime")

    def write(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        shown.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def trace_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every released piece with the batch that released it."""
    return spark.read.schema(f"{OUT}, batch long").parquet(path)


def trace_texts(spark: SparkSession, path: str) -> DataFrame:
    """What was shown of each channel so far, and how many events were skipped."""
    piece = F.struct("batch", "ordinal", "text")
    return trace_rows(spark, path).groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
        F.sum("skipped").alias("skipped"),
    )
