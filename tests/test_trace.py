from __future__ import annotations

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakstone.functions.detectors import DEFAULT_PATTERNS, TextPattern
from cloakstone.operators.scan import redact
from cloakstone.sources.event_log import stream_event_log
from cloakstone.streaming.trace import CONTEXT, Masker, start_trace, trace_rows, trace_texts, widest

PLANTED = {"ssn": "900-00-9999", "name": "Tamsin Orrell"}
MASKER = Masker(PLANTED, DEFAULT_PATTERNS)
TEXT = (
    "Seen Tamsin Orrell (900-00-9999) on 1950-03-13 or Mar 3, 1951; write to p.x+1@mail.example.com. "
    "Not an id: 12345-12-1234, 2001/1/1.\nMRN: 0012345, (555) 555-0123, 12 Elm Way, North End, OH 44101 end"
)


def streamed(pieces):
    before = held = ""
    out = []
    for piece in pieces:
        shown, before, held = MASKER.feed(before, held, piece)
        assert len(before) <= CONTEXT and len(held) <= 2 * max(widest(p.regex) for p in DEFAULT_PATTERNS)
        out.append(shown)
    return [*out, MASKER.mask(before, held)]


def test_masked_text_is_that_of_the_batch_operator(spark):
    texts = [TEXT, TEXT * 3, "", "nothing", "a@b.co.uk", "917-30-5521" * 2, "Tamsin OrrellTamsin Orrell"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    want = {r["i"]: r["text"] for r in redact(rows, "text", PLANTED).collect()}
    assert [MASKER.mask("", t) for t in texts] == [want[i] for i in range(len(texts))]
    assert "900-00-9999" not in want[0] and "12345-12-1234" in want[0]


def test_a_split_at_every_position_changes_nothing():
    whole = MASKER.mask("", TEXT)
    for at in range(len(TEXT) + 1):
        assert "".join(streamed([TEXT[:at], TEXT[at:]])) == whole, at
    assert "".join(streamed(list(TEXT))) == whole


@given(st.integers(0, 10**9), st.lists(st.sampled_from([TEXT[5:40], "900-0", "0-9999", "Tamsin ", "Orrell", " 917-30-", "5521 ", "a@b.com.", "x", " ", "\n", "1", "12 Elm, ", "MRN", "é"]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_any_split_of_any_text_changes_nothing(seed, parts):
    text, rnd = "".join(parts), random.Random(seed)
    cuts = sorted(rnd.randrange(len(text) + 1) for _ in range(rnd.randrange(12)))
    pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    shown = "".join(streamed(pieces))
    assert shown == MASKER.mask("", text)
    assert not any(v in shown for v in PLANTED.values())


def test_only_an_open_end_is_held_back():
    out, _, held = MASKER.feed("", "", "It is said that all went well! ")
    assert out == "It is said that all went well! " and held == ""
    out, _, held = MASKER.feed("", "", "call 555-01")
    assert out == "call " and held == "555-01"
    out, _, held = MASKER.feed("", "", "by Tamsin Or")
    assert out == "by " and held == "Tamsin Or"


def test_unbounded_patterns_are_refused():
    with pytest.raises(ValueError):
        Masker({}, (TextPattern("word", "[a-z]+"),))


def put(folder, number, *rows):
    folder.mkdir(exist_ok=True)
    file = folder / f"{number:03d}.json"
    file.write_text("".join(json.dumps({"session_id": "s", "thread_id": "main", "type": "model.message.delta", **r}) + "\n" for r in rows))
    os.utime(file, (1_000_000_000 + number,) * 2)


def test_trace_of_a_stream(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "trace")
    put(log, 0, {"seq": 1, "id": "m", "content": "id 900-"}, {"seq": 3, "id": "n", "content": "mail a.b"}, {"seq": 2, "id": "m", "content": "00-99"})
    put(log, 1, {"seq": 4, "id": "m", "content": "99, so"}, {"seq": 2, "id": "m", "content": "00-99"}, {"seq": 5, "id": "n", "content": "@c.org now"})
    call = [{"id": "c1", "function": {"name": "run", "arguments": "Tamsin"}}]
    put(log, 2, {"seq": 6, "id": "m", "content": None, "reasoning_content": "so 917-30-5521?", "tool_calls": call})
    put(log, 3, {"seq": 7, "id": "m", "tool_calls": [{"id": "c1", "function": {"arguments": " Orrell)"}}]})
    put(log, 4, {"seq": 100_000, "id": "clock", "session_id": "clock"})
    put(log, 5, {"seq": 100_001, "id": "clock", "session_id": "clock"})
    stream = stream_event_log(spark, str(log), 1).withColumn("at", F.timestamp_seconds("seq"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = start_trace(stream, path, str(tmp_path / "checkpoint"), PLANTED, lateness="10 seconds", patience="60 seconds")
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {(r["id"], r["channel"]): (r["text"], r["skipped"]) for r in trace_texts(spark, path).collect()}
    assert got == {
        ("m", "text"): ("id [canary:ssn:redacted], so", 1), ("n", "text"): ("mail [email:redacted] now", 0),
        ("m", "reasoning"): ("so [us-ssn:redacted]?", 0), ("m", "call:c1"): ("[canary:name:redacted])", 0),
    }
    early = [r["text"] for r in trace_rows(spark, path).where("batch = 0").collect()]
    assert sorted(early) == ["id ", "mail "]  # shown while it runs, without the open end
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 0


def test_channels_of_one_group_share_calls_but_not_text(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "trace")
    names = [f"m{n}" for n in range(40)]
    put(log, 0, *[{"seq": 1, "id": m, "content": f"{m} has 900-"} for m in names])
    put(log, 1, *[{"seq": 2, "id": m, "content": "00-9999 "} for m in names[:30]], {"seq": 2, "id": "late", "content": "ends in 900-"})
    put(log, 2, {"seq": 61, "id": "m0", "content": "still 900-"})
    put(log, 3, {"seq": 75, "id": "clock", "session_id": "clock"})  # all but m0 are over
    put(log, 4, {"seq": 76, "id": "m0", "content": "00-9999"}, {"seq": 77, "id": "clock", "session_id": "clock"})
    put(log, 5, {"seq": 100_000, "id": "clock", "session_id": "clock"})
    put(log, 6, {"seq": 100_001, "id": "clock", "session_id": "clock"})
    stream = stream_event_log(spark, str(log), 1).withColumn("at", F.timestamp_seconds("seq"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = start_trace(stream, path, str(tmp_path / "checkpoint"), PLANTED, lateness="1 seconds", patience="60 seconds", groups=1)
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r["id"]: r["text"] for r in trace_texts(spark, path).collect()}
    masked = {m: f"{m} has [canary:ssn:redacted] " if n < 30 else f"{m} has 900-" for n, m in enumerate(names)}
    assert got == {**masked, "m0": masked["m0"] + "still [canary:ssn:redacted]", "late": "ends in 900-"}
    assert query.recentProgress[0].stateOperators[0].numRowsTotal <= len(names) + 2  # one timer and one count for all
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 0
