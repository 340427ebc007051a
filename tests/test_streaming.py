from __future__ import annotations

import json
import os
import time

import pytest

from cloakstone.operators import events as e
from cloakstone.sources.event_log import read_event_log, stream_event_log
from cloakstone.streaming import merge


def put(folder, number, *rows):
    folder.mkdir(exist_ok=True)
    file = folder / f"{number:03d}.json"
    file.write_text("".join(json.dumps({"session_id": "s", "thread_id": "main", **r}) + "\n" for r in rows))
    os.utime(file, (1_000_000_000 + number,) * 2)  # a stream takes files by their time


@pytest.fixture()
def run(spark, tmp_path):
    """Stream a folder of files one file per batch, to the end."""

    def go(start, **options):
        stream = stream_event_log(spark, str(tmp_path / "log"), 1)
        start(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), **options).awaitTermination()
        return str(tmp_path / "table")

    return go, tmp_path / "log"


def base(seq, text, id="m"):
    return {"seq": seq, "id": id, "type": "model.message", "content": text}


def delta(seq, text, id="m"):
    return {"seq": seq, "id": id, "type": "model.message.delta", "content": text}


def same_as_batch(spark, table, log):
    columns = ["id", "type", "text", "first_seq", "last_seq"]
    streamed = sorted(map(tuple, merge.merged_view(spark, table).select(*columns).collect()))
    assert streamed == sorted(map(tuple, e.merge_events(read_event_log(spark, str(log))).select(*columns).collect()))
    return {r[0]: r[2] for r in streamed}


@pytest.mark.parametrize("block", [2, 4096])
def test_value_split_over_batches_and_blocks(spark, run, block):
    go, log = run
    put(log, 0, base(0, "id 917-30"), base(1, "other", "n"))
    put(log, 1, delta(2, "-55"), delta(3, " more", "n"))
    put(log, 2, delta(4, "21 end"))
    table = go(merge.start_live_scan, canaries={"ssn": "917-30-5521"}, patterns=(), trace=True, block=block)
    assert same_as_batch(spark, table, log) == {"m": "id 917-30-5521 end", "n": "other more"}
    assert [(r["text_id"], r["offset"]) for r in merge.live_hits(spark, table).collect()] == [("s/main/m", 3)]
    shown = [r["text"] for r in spark.read.parquet(f"{table}/trace").collect()]
    assert "id [canary:ssn:redacted] end" in shown and not any("917-30-5521" in t for t in shown)


def test_copies_late_rows_and_orphans(spark, run):
    go, log = run
    put(log, 0, delta(2, "tail"), base(5, "x", "n"))
    put(log, 1, delta(2, "tail"), base(1, "head"), {"seq": 6, "id": "d", "type": "thread.done"})
    put(log, 2, delta(3, "!"), delta(7, "y", "n"))
    table = go(merge.start_merge, block=2)
    assert same_as_batch(spark, table, log)["m"] == "headtail!"


def test_resume_from_checkpoint(spark, run):
    go, log = run
    put(log, 0, base(0, "first"))
    go(merge.start_merge)
    put(log, 1, delta(1, " second"))
    table = go(merge.start_merge)
    assert same_as_batch(spark, table, log)["m"] == "first second"


def test_a_gap_or_a_dropped_row_is_never_a_pass(spark, run):
    go, log = run
    put(log, 0, base(0, "a"), delta(1, "b"))
    put(log, 1, delta(2, "c"))
    table = go(merge.start_live_scan)
    assert merge.stream_verdict(spark, table, 0).first()["passed"]
    assert not merge.stream_verdict(spark, table, dropped_rows=1).first()["passed"]
    put(log, 2, delta(4, "d"))
    table = go(merge.start_live_scan)
    row = merge.stream_verdict(spark, table, 0).first()
    assert (row["sessions_incomplete"], row["complete"], row["passed"]) == (1, False, False)


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_hits_are_never_withdrawn(spark, run, block):
    go, log = run
    put(log, 0, base(0, "see 917-30-5521"), base(1, "id 917-30", "n"))
    put(log, 1, base(7, "other text"), base(8, "xx", "n"), delta(9, "-5521", "n"))
    table = go(merge.start_live_scan, canaries={"ssn": "917-30-5521"}, patterns=(), block=block)
    merged = same_as_batch(spark, table, log)
    found = {r["text_id"] for r in merge.live_hits(spark, table).collect()}
    assert found == {f"s/main/{i}" for i, text in merged.items() if "917-30-5521" in text} and "s/main/m" in found
    assert not merge.stream_verdict(spark, table, 0).first()["passed"]


def test_snapshots_change_nothing(spark, run, tmp_path):
    go, log = run
    put(log, 0, base(0, "a"), base(1, "x", "n"))
    for number in range(1, 6):
        put(log, number, delta(2 * number, f"<{number}>"), delta(2 * number + 1, "!", "n"))
    table = go(merge.start_merge, block=2, snapshot_every=2)
    assert sorted(p.name for p in (tmp_path / "table/snapshots").iterdir()) == ["upto=2", "upto=4"]
    assert same_as_batch(spark, table, log) == {"m": "a<1><2><3><4><5>", "n": "x!!!!!"}
    assert merge.stream_gaps(spark, table).first()["complete"]


def test_gaps_count_distinct_numbers(spark, run):
    go, log = run
    put(log, 0, base(1, "a"), base(2, "b", "n"))
    put(log, 1, base(2, "c", "o"), base(4, "d", "p"))
    table = go(merge.start_live_scan, block=2)
    row = merge.stream_gaps(spark, table).first()
    assert (row["missing"], row["complete"]) == (1, False)
    batch = e.sequence_gaps(read_event_log(spark, str(log))).first()
    assert (batch["missing"], batch["complete"]) == (1, False)


def test_unreadable_lines_fail_the_stream(spark, run):
    go, log = run
    put(log, 0, base(0, "a"))
    (log / "001.json").write_text('{"session_id":"s","seq":\n')
    table = go(merge.start_live_scan)
    assert not merge.stream_verdict(spark, table, 0).first()["passed"]


def test_dictionary_values_are_found_live(spark, run):
    go, log = run
    put(log, 0, base(0, "a Marlow"), base(1, "nothing", "n"))
    put(log, 1, delta(2, "e-Quint b"))
    table = go(merge.start_live_scan, patterns=(), dictionary=spark.createDataFrame([("Marlowe-Quint",), ("absent one",)], "value string"))
    assert [(r["text_id"], r["occurrences"]) for r in merge.live_values(spark, table).collect()] == [("s/main/m", 1)]


def test_late_rows_are_counted_over_the_whole_run(spark, tmp_path):
    log, late = tmp_path / "log", merge.LateRows()
    for number, seqs in enumerate(([10_000], [20_000], [5, 6], [20_001], [7])):
        put(log, number, *[base(n, "x", f"m{n}") for n in seqs])
    events = stream_event_log(spark, str(log), 1).selectExpr("*", "timestamp_seconds(seq) as ts")
    spark.streams.addListener(late)
    try:
        query = merge.deduplicated(events, "ts", "10 seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(50):
            if late.of(query) == 3:
                break
            time.sleep(0.2)
        assert late.of(query) == 3
    finally:
        spark.streams.removeListener(late)


def test_streaming_deduplication_plan(spark, run):
    _, log = run
    put(log, 0, base(0, "a"))
    events = stream_event_log(spark, str(log)).selectExpr("*", "timestamp_seconds(seq) as ts")
    assert merge.deduplicated(events, "ts", "1 hour").isStreaming
