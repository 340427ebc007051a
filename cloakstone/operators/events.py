"""Rebuild what a model could see from an event log: merge, order, flatten, extract."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakstone.functions.text import whole

# Thread names and event types of the log format.
TURN_THREAD = "__turn__"
MAIN_THREAD = "main"
VISIBLE_TYPES = ("model.message", "tool.response")
DELTA_SUFFIX = ".delta"

_LEAF = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+\-]*|true|false'  # of a JSON text

BLOCK = 4096  # sequence numbers folded together before rows of one message meet
UNNUMBERED = (1 << 63) - 1  # the block of events without a number, after all others


def extract_text(content: Column, depth: int = 3) -> Column:
    """Flatten polymorphic content to text.

    Text as is; numbers and booleans as written; lists joined by newlines; objects by their
    text, else their content, else whole as JSON.  Lists nested deeper than ``depth`` give all
    their strings, names and numbers, unescaped, one a line: showing too much to a scanner is
    the safe direction, and an escape must not hide a value.
    """
    kind = F.schema_of_variant(content)

    def member(name: str) -> Column:
        value = F.try_variant_get(content, f"$.{name}", "variant")
        is_text = F.schema_of_variant(value) == "STRING"
        return F.when(is_text, F.try_variant_get(content, f"$.{name}", "string"))

    if depth > 0:
        parts = F.transform(
            F.try_variant_get(content, "$", "array<variant>"), lambda v: extract_text(v, depth - 1)
        )
        listed = F.array_join(F.filter(parts, lambda s: s != ""), "\n")
    else:
        leaves = F.regexp_extract_all(F.to_json(content), F.lit(_LEAF), F.lit(0))
        strings = F.from_json(F.concat(F.lit("["), F.array_join(leaves, ","), F.lit("]")), "array<string>")
        listed = F.array_join(strings, "\n")
    return (
        F.when(content.isNull() | (kind == "VOID"), "")
        .when(kind == "STRING", F.try_variant_get(content, "$", "string"))
        .when(kind.startswith("ARRAY"), listed)
        .when(kind.startswith("OBJECT"), F.coalesce(member("text"), member("content"), F.to_json(content)))
        .otherwise(F.coalesce(F.try_variant_get(content, "$", "string"), F.to_json(content)))
    )


def thread_of(thread_id: Column) -> Column:
    return F.coalesce(thread_id, F.lit(TURN_THREAD))


def _joined(kept: Column, added: Column) -> Column:
    """Text of a repeated event: never lose any, never repeat what is already there."""
    return (
        F.when((kept == "") | F.contains(added, kept), added)
        .when((added == "") | F.contains(kept, added), kept)
        .otherwise(F.concat(added, F.lit("\n"), kept))
    )


def normalised(log: DataFrame, *kept: str) -> DataFrame:
    """Raw events with text flattened and deltas marked; narrow.  Columns in ``kept`` stay."""
    base = F.col("type")
    return log.select(
        *kept,
        F.coalesce("session_id", F.lit("")).alias("session_id"),  # a line that names no session is not lost
        thread_of(F.col("thread_id")).alias("thread_id"),
        F.coalesce("id", F.lit("")).alias("id"),
        "seq",
        base.endswith(DELTA_SUFFIX).alias("is_delta"),
        F.regexp_replace(base, r"\.delta$", "").alias("type"),
        extract_text(F.col("content")).alias("text"),
        F.coalesce("reasoning_content", F.lit("")).alias("reasoning"),
        "tool_calls",
        (F.coalesce(F.schema_of_variant("content"), F.lit("VOID")).isin("STRING", "VOID")).alias("plain"),
    )


def fold_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """First stage: within a block of sequence numbers, a message becomes a few segments.

    A segment is an event and, apart from it, the concatenated deltas that follow.  Keying by block as well as by
    message means even one message holding a third of the log is spread over tasks, and
    no task collects more than ``block`` distinct rows of it.  Redelivered copies vanish
    because the rows are collected as a set.
    """
    part = F.struct("seq", "is_delta", "type", "text", "reasoning", "tool_calls")
    numbered = F.array_sort(F.collect_set(F.when(F.col("seq").isNotNull(), part)))
    # Without a number nothing tells a redelivered event from an equal one, so all are kept, last.
    unnumbered = F.collect_list(F.when(F.col("seq").isNull(), part))
    folded = (
        rows.withColumn("block", F.coalesce(whole(F.col("seq"), block), F.lit(UNNUMBERED)))
        .groupBy("session_id", "thread_id", "id", "block")
        .agg(
            F.concat(numbered, unnumbered).alias("parts"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.bool_and("plain").alias("plain"),
        )
    )
    parts, size = F.col("parts"), F.size("parts")
    no_calls = F.array().cast("array<struct<id:string,source_event_id:string,function:struct<name:string,arguments:string>>>")
    folded = folded.withColumns(
        {
            "starts": F.filter(
                F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | ~F.get(parts, i)["is_delta"]
            ),
            "seqs": F.array_distinct(F.filter(F.transform(parts, lambda p: p["seq"]), lambda n: n.isNotNull())),
            "calls": F.flatten(
                F.transform(
                    parts,
                    lambda p: F.transform(
                        F.coalesce(p["tool_calls"], no_calls),
                        lambda c: F.struct(p["is_delta"].alias("is_delta"), c.alias("call")),
                    ),
                )
            ),
        }
    )

    def segment(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), size)
        head = F.get(parts, start)
        skip = F.when(head["is_delta"], 0).otherwise(1)
        tail = F.slice(parts, start + skip + 1, end - start - skip)

        def own(name: str) -> Column:
            return F.when(head["is_delta"], "").otherwise(head[name]).alias(name)

        return F.struct(
            head["seq"].alias("seq"),
            head["is_delta"].alias("is_delta"),
            head["type"].alias("type"),
            own("text"),
            own("reasoning"),
            F.array_join(F.transform(tail, lambda p: p["text"]), "").alias("text_tail"),
            F.array_join(F.transform(tail, lambda p: p["reasoning"]), "").alias("reasoning_tail"),
        )

    folded = folded.withColumn("segments", F.transform("starts", segment))
    # An event equal to the one just before it, with no deltas in between or behind, adds
    # nothing to the merged text: drop runs of such repeats.
    def news(segment: Column, k: Column) -> Column:
        before = F.get(F.col("segments"), k - 1)
        changed = (k == 0) | segment["is_delta"]
        for name in ("text", "reasoning", "type", "text_tail", "reasoning_tail"):
            changed = changed | (segment[name] != before[name])
        return changed | (segment["text_tail"] != "") | (segment["reasoning_tail"] != "")

    return folded.withColumn("segments", F.filter("segments", news)).drop("parts", "starts")


def _merged_calls(calls: Column) -> Column:
    """One call per id, in order of appearance: deltas append arguments, repeats never lose any."""
    start = F.struct(
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("name"), F.lit("").alias("arguments")
    )

    def step(acc: Column, c: Column) -> Column:
        given = F.coalesce(c["call"]["function"]["arguments"], F.lit(""))
        text = F.when(c["is_delta"], F.concat(acc["arguments"], given)).otherwise(_joined(acc["arguments"], given))
        return F.struct(
            F.coalesce(c["call"]["source_event_id"], acc["source"]).alias("source"),
            F.coalesce(c["call"]["function"]["name"], acc["name"]).alias("name"),
            text.alias("arguments"),
        )

    def merged(call_id: Column) -> Column:
        own = F.filter(calls, lambda c: c["call"]["id"].eqNullSafe(call_id))
        return F.aggregate(
            own, start, step,
            lambda a: F.struct(
                call_id.alias("id"), a["source"].alias("source_event_id"),
                F.struct(a["name"].alias("name"), a["arguments"].alias("arguments")).alias("function"),
            ),
        )

    return F.transform(F.array_distinct(F.transform(calls, lambda c: c["call"]["id"])), merged)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(segments: Column, name: str) -> Column:
    """The merged text of one field: linear in the segments but for the distinct texts among them.

    The text so far holds every earlier event's text, so an event that repeats one of them only adds the
    deltas behind it.  Repeats are found by sorting; the texts that are new split the segments, and
    the deltas between two of them are joined at once.
    """

    def tails(begin: Column, end: Column) -> Column:
        return F.array_join(F.transform(F.slice(segments, begin + 1, end - begin), lambda s: s[f"{name}_tail"]), "")

    def first(ordered: Column) -> Column:
        new = F.filter(
            ordered, lambda e, k: (e["head"] != "") & ((k == 0) | (e["head"] != F.get(ordered, k - 1)["head"]))
        )
        return F.array_sort(F.transform(new, lambda e: e["at"]))

    def split(starts: Column) -> Column:
        size = F.size(segments)
        parts = F.transform(
            starts,
            lambda at, j: F.struct(
                F.get(segments, at)[name].alias("head"), tails(at, F.coalesce(F.get(starts, j + 1), size)).alias("tail")
            ),
        )
        return F.aggregate(
            parts, tails(F.lit(0), F.coalesce(F.get(starts, F.lit(0)), size)),
            lambda acc, part: F.concat(_joined(acc, part["head"]), part["tail"]),
        )

    heads = F.transform(segments, lambda s, i: F.struct(s[name].alias("head"), i.alias("at")))
    return _let(F.array_sort(heads), lambda ordered: _let(first(ordered), split))


def join_blocks(folded: DataFrame) -> DataFrame:
    """Second stage: fold the few segments of each message in sequence order."""

    def kind(acc: Column, s: Column) -> Column:
        return F.when(s["is_delta"], F.coalesce(acc, s["type"])).otherwise(s["type"])

    def fold(segments: Column) -> Column:
        return F.struct(
            _folded(segments, "text").alias("text"), _folded(segments, "reasoning").alias("reasoning"),
            F.aggregate(segments, F.lit(None).cast("string"), kind).alias("type"),
        )

    blocks = F.array_sort(F.collect_list(F.struct("block", "segments", "calls")))
    # The fold is part of the aggregate: as a projection above it, a later filter on the
    # merged text or type would be pushed through and run the fold again.
    merged = _let(F.flatten(F.transform(blocks, lambda b: b["segments"])), fold)
    calls = _merged_calls(F.flatten(F.transform(blocks, lambda b: b["calls"])))
    return folded.groupBy("session_id", "thread_id", "id").agg(
        merged.alias("merged"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.when(F.size(calls) > 0, calls).alias("tool_calls"),
        F.bool_and("plain").alias("plain"),
    ).select(
        "session_id", "thread_id", "id", "first_seq", "last_seq",
        "merged.type", "merged.text", "merged.reasoning", "tool_calls", "plain",
    )


def merge_events(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (session, thread, id) with deltas merged into their event.

    A delta without its event (a resumed stream) starts the row itself; the event arriving
    later is joined to it.  Order is always by sequence number, never by arrival in a file.
    """
    return join_blocks(fold_blocks(normalised(log), block))


def reading_order(events: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``thread_first_seq`` and ``position`` (from 1 within the thread): a session's reading order.

    Ranked inside blocks of sequence numbers, then shifted by the counts of earlier
    blocks, so a thread holding most of the log is not sorted in one task.  Both come from one
    small table of blocks, joined on (thread, block): no key is wider than a block.
    """
    from pyspark.sql import Window

    keyed = events.withColumn("block", F.coalesce(whole(F.col("first_seq"), block), F.lit(UNNUMBERED)))
    keys = ["session_id", "thread_id"]
    thread = Window.partitionBy(*keys)
    before = thread.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("block_first")
    ).select(
        *keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.min("block_first").over(thread).alias("thread_first_seq"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("first_seq", "id"))
    return (
        keyed.withColumn("rank", rank).join(offsets, [*keys, "block"])
        .withColumn("position", F.col("rank") + F.col("earlier")).drop("rank", "earlier", "block")
    )


def visible_rows(merged: DataFrame, visible_types: tuple[str, ...] = VISIBLE_TYPES) -> DataFrame:
    """Text a model could read, one row per merged event: content, reasoning, call arguments."""
    arguments = F.coalesce(
        F.transform("tool_calls", lambda c: c["function"]["arguments"]), F.array().cast("array<string>")
    )
    pieces = F.concat(F.array("text", "reasoning"), arguments)
    text = F.array_join(F.filter(pieces, lambda s: s.isNotNull() & (s != "")), "\n")
    return (
        merged.where(F.col("type").isin(*visible_types))
        .select("session_id", "thread_id", "id", "first_seq", "type", text.alias("text"))
        .where("text <> ''")
    )


def main_text(merged: DataFrame) -> DataFrame:
    """The main thread's assistant text, as rows in ``first_seq`` order per session."""
    return merged.where(
        (F.col("thread_id") == MAIN_THREAD) & (F.col("type") == "model.message") & (F.col("text") != "")
    ).select("session_id", "id", "first_seq", "text")


def thread_summary(log: DataFrame) -> DataFrame:
    """Per thread: raw and merged events, first sequence, finished flag, subagent flag.

    Finished threads stay: a scan after the turn needs exactly their transcript.
    """
    thread = thread_of(F.col("thread_id"))
    per_id = log.groupBy("session_id", thread.alias("thread_id"), "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("first_seq"),
        F.bool_or(F.col("type") == "thread.done").alias("done"),
    )
    return per_id.groupBy("session_id", "thread_id").agg(
        F.sum("n").alias("raw_events"),
        F.count(F.lit(1)).alias("merged_events"),
        F.min("first_seq").alias("first_seq"),
        F.bool_or("done").alias("done"),
    ).withColumn("is_subagent", ~F.col("thread_id").isin(MAIN_THREAD, TURN_THREAD))


def session_summary(log: DataFrame) -> DataFrame:
    """Per session: highest sequence number, latest turn and sandbox id."""

    def latest(column: str, kind: str) -> Column:
        seen = (F.col("type") == kind) & F.col(column).isNotNull()
        return F.max_by(column, F.when(seen, F.col("seq")))

    return log.groupBy("session_id").agg(
        F.max("seq").alias("last_sequence"),
        latest("turn_id", "turn.created").alias("turn_id"),
        latest("sandbox_id", "sandbox.created").alias("sandbox_id"),
    )


def type_histogram(log: DataFrame, column: str = "type") -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def sequence_gaps(log: DataFrame) -> DataFrame:
    """Per session: events seen, duplicates, missing numbers, and whether a scan is complete.

    Replaces any cap on session size: a session of any length is scanned whole, and one
    with a hole in its numbering, or with lines that could not be read, cannot be called clean.
    Malformed lines name no session, so they make a row of their own.
    """
    malformed = F.col("malformed") if "malformed" in log.columns else F.lit(False)
    delivered = log.groupBy("session_id", "seq").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(malformed).alias("malformed")
    )
    return gap_verdicts(
        delivered.groupBy("session_id").agg(
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.count("seq").alias("distinct_seqs"),
            F.sum(F.when(F.col("seq").isNotNull(), F.col("copies") - 1).otherwise(0)).alias("duplicates"),
            F.sum("malformed").alias("malformed"),
        )
    )


def gap_verdicts(counted: DataFrame) -> DataFrame:
    """Missing numbers and completeness from first, last, distinct numbers and malformed lines."""
    return counted.withColumn(
        "missing", F.col("last_seq") - F.col("first_seq") + 1 - F.col("distinct_seqs")
    ).withColumn("complete", F.coalesce((F.col("missing") == 0) & (F.col("malformed") == 0), F.lit(False)))


def _parsed(column: str) -> Column:
    """The JSON value of a text column; rows without one are dropped.

    Generating it keeps later filters from repeating the parse.
    """
    value = F.array(F.try_parse_json(column))
    return F.explode(F.filter(value, lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID")))


def exec_results(merged: DataFrame) -> DataFrame:
    """Command results carried by tool responses; responses that are not JSON text are skipped."""
    rows = merged.where((F.col("type") == "tool.response") & F.col("plain")).select(
        "session_id", "thread_id", "id", "first_seq", _parsed("text").alias("v")
    )

    def typed(path: str, kinds: tuple[str, ...], to: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
        fits = F.lit(False)
        for k in kinds:
            fits = fits | kind.startswith(k)
        return F.when(fits, F.try_variant_get("v", path, to))

    return rows.select(
        "session_id", "thread_id", "id", "first_seq",
        F.coalesce(typed("$.success", ("BOOLEAN",), "boolean"), F.lit(False)).alias("success"),
        typed("$.response.exitCode", ("BIGINT", "DECIMAL", "DOUBLE"), "bigint").alias("exit_code"),
        F.coalesce(typed("$.response.result", ("STRING",), "string"), F.lit("")).alias("output"),
    )


def exec_failures(results: DataFrame) -> DataFrame:
    """Failed commands by exit code and output length; the output itself is withheld."""
    failed = ~F.col("success") | (F.coalesce("exit_code", F.lit(0)) != 0)
    return results.where(failed).select(
        "session_id", "thread_id", "id", "first_seq", "exit_code",
        F.length("output").cast("bigint").alias("output_chars"),
    )


# A quoted string counts as one token, so braces inside it are never seen.
_TOKEN = r'"(?:[^"\\]|\\.)*"?|[{}]'


def _balanced(text: str, token: re.Pattern) -> Iterator[str]:
    opened: list[int] = []
    for match in token.finditer(text):
        if match.group() == "{":
            opened.append(match.start())
        elif match.group() == "}" and opened:
            start = opened.pop()
            if not opened:
                yield text[start : match.end()]


def _payload_rows(keys: list[str], column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = re.compile(_TOKEN, re.DOTALL)
        for batch in batches:
            rows = (
                (*key, ordinal, payload)
                for *key, text in batch[[*keys, column]].itertuples(index=False, name=None)
                for ordinal, payload in enumerate(_balanced(text, token))
            )
            while chunk := list(itertools.islice(rows, 10_000)):
                yield pd.DataFrame(chunk, columns=[*keys, "ordinal", "payload"])

    return run


def embedded_payloads(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Every balanced top-level JSON object inside a text column; the text around it is ignored."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType(
        [rows.schema[k] for k in keys]
        + [StructField("ordinal", LongType()), StructField("payload", StringType())]
    )
    return (
        rows.where(F.contains(F.col(column), F.lit("{"))).select(*keys, column)
        .mapInPandas(_payload_rows(keys, column), schema)
        .where(F.try_parse_json("payload").isNotNull())  # balanced, but not JSON
    )


def judged_payloads(payloads: DataFrame, expected_run: Column) -> DataFrame:
    """Type each payload and say why it is not believed.

    Shape alone proves nothing: every field must be there with its type, and the payload
    must quote this run's id.
    """
    judged = payloads.select("*", expected_run.alias("expected_run"), _parsed("payload").alias("v"))

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("MISSING"))

    def number(path: str) -> Column:
        return kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE)")

    def array(path: str) -> Column:
        return kind(path).startswith("ARRAY")

    check = F.when(kind("$.check") == "STRING", F.try_variant_get("v", "$.check", "string"))
    run = F.when(kind("$.run_id") == "STRING", F.try_variant_get("v", "$.run_id", "string"))
    version = F.when(number("$.schema_version"), F.try_variant_get("v", "$.schema_version", "double"))
    shapes = {
        "verification": (
            check == "scrub",
            (kind("$.passed") == "BOOLEAN") & number("$.row_count") & array("$.columns")
            & array("$.surviving_identifier_columns") & kind("$.canary_present").isin("BOOLEAN", "VOID"),
        ),
        "verdict": (
            check.isNull() & array("$.columns"),
            number("$.row_count") & number("$.column_count") & array("$.pii_columns"),
        ),
        "analysis": (
            check.isNull() & kind("$.primary").startswith("OBJECT"),
            number("$.primary.difference") & number("$.primary.t_statistic")
            & number("$.primary.p_value") & number("$.safety.chi2") & number("$.safety.p_value"),
        ),
    }
    what = F.lit(None).cast("string")
    sound = F.lit(False)
    for name, (recognised, shape) in reversed(shapes.items()):
        what = F.when(recognised, name).otherwise(what)
        sound = F.when(recognised, shape).otherwise(sound)
    judged = judged.withColumns({"kind": what, "sound": sound, "run": run, "version": version})
    versioned = (F.col("kind") == "analysis") | F.coalesce(F.col("version") == 1, F.lit(False))
    reason = (
        F.when(F.col("kind").isNull(), "unrecognised")
        .when(~F.coalesce(F.col("run") == F.col("expected_run"), F.lit(False)), "other run")
        .when(~versioned, "schema version")
        .when(~F.col("sound"), "malformed")
    )
    return judged.withColumn("reason", reason).drop("v", "sound", "run", "version")


def bound_payloads(judged: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first believed payload per run and kind."""
    first = F.min_by("payload", F.struct(*order))
    return judged.where("reason is null").groupBy(*keys, "kind").agg(first.alias("payload"))


def rejected_payloads(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))
