from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cloakstone.operators import approval as a
from cloakstone.operators import events as e
from cloakstone.sources.event_log import parse_sequence, read_event_log

MAIN = "main"


@pytest.fixture()
def log(spark, tmp_path):
    """Events given as dicts, written as a JSON log in an unhelpful order and read back."""
    count = iter(range(100))

    def make(*events, session="s"):
        rows = [{"session_id": session, "seq": i, **ev} for i, ev in enumerate(events)]
        path = tmp_path / f"log{next(count)}"
        path.mkdir()
        for part, chunk in enumerate((rows[::2], rows[1::2])):
            (path / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in reversed(chunk)))
        return read_event_log(spark, str(path))

    return make


def msg(id, content, thread=MAIN, **extra):
    return {"type": "model.message", "id": id, "thread_id": thread, "content": content, **extra}


def delta(id, content, thread=MAIN, **extra):
    return {"type": "model.message.delta", "id": id, "thread_id": thread, "content": content, **extra}


def texts(df, **options):
    rows = e.visible_rows(e.merge_events(df, **options)).orderBy("first_seq").collect()
    return [r["text"] for r in rows]


@pytest.mark.parametrize(
    ("content", "text"),
    [
        ("hello", "hello"), (None, ""), ([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "a\nb"),
        (["a", {"text": "b"}, 42], "a\nb\n42"), (42, "42"), (True, "true"), ({"content": "x", "more": 1}, "x"),
        ({"text": 5, "content": "y"}, "y"), ('{"text":"kept whole"}', '{"text":"kept whole"}'), ("42", "42"), ([["p", ["q"]], ""], "p\nq"),
    ],
)
def test_flattening(log, content, text):
    assert e.normalised(log(msg("m", content))).first()["text"] == text


def test_unknown_objects_are_kept_whole(log):
    text = e.normalised(log(msg("m", {"rows": [{"ssn": "917-30-5521"}]}))).first()["text"]
    assert "917-30-5521" in text
    deep = [[[[[{"note": 'a "quoted"\nline', "n": [1.5, True]}]]]]]
    text = e.normalised(log(msg("m", deep))).first()["text"]
    assert 'note\na "quoted"\nline' in text and "n\n1.5\ntrue" in text


@pytest.mark.parametrize(
    ("events", "merged"),
    [
        ([msg("m", "Green"), delta("m", " apples"), delta("m", " fall.")], ["Green apples fall."]),
        ([delta("m", "only the end")], ["only the end"]),
        ([delta("m", "SEEDED"), msg("m", "opening")], ["opening\nSEEDED"]),
        ([delta("m", "two"), msg("m", "two words")], ["two words"]),
        ([msg("m", "two words"), msg("m", "words")], ["two words"]),
        ([msg("m", "a"), msg("m", "b"), delta("m", "c"), msg("m", "a")], ["b\nac"]),
        ([delta("m", "x"), delta("m", "y"), msg("m", "z"), delta("m", "!")], ["z\nxy!"]),
        ([msg("m", "a"), msg("m", None)], ["a"]),
        ([msg("m1", "first"), msg("m2", "second"), msg("m3", "third")], ["first", "second", "third"]),
        ([msg("m", "root"), msg("m", "sub", thread="sub-a")], ["root", "sub"]),
    ],
)
@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_merging(log, events, merged, block):
    """The block only decides how the work is cut up, never the result."""
    assert texts(log(*events), block=block) == merged


def test_redelivered_events_are_merged_once(log):
    df = log(msg("m", "Once"), delta("m", " only"))
    assert texts(df.union(df).union(df)) == ["Once only"]


def test_orphan_type_and_last_fields(log):
    df = log(delta("m", "x"), msg("m", "y", tool_calls=[{"id": "c1", "function": {"name": "f", "arguments": "A"}}]), msg("m", "y"))
    row = e.merge_events(df).first()
    assert row["type"] == "model.message" and row["tool_calls"][0]["id"] == "c1"
    assert e.merge_events(log(delta("m", "x"))).first()["type"] == "model.message"


def test_long_message_over_many_blocks(spark):
    n = 5000
    rows = [("s", i, "m", "model.message" if i == 0 else "model.message.delta", f"<{i}>") for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, seq long, id string, type string, t string").repartition(5)
    df = df.select(
        "session_id", "seq", "id", "type", F.lit("main").alias("thread_id"), F.col("t").cast("variant").alias("content"),
        F.lit(None).cast("string").alias("reasoning_content"),
        F.lit(None).cast("array<struct<id:string,source_event_id:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"),
    )
    row = e.merge_events(df, block=64).first()
    assert row["text"] == "".join(f"<{i}>" for i in range(n)) and (row["first_seq"], row["last_seq"]) == (0, n - 1)


def test_visible_text_has_reasoning_and_arguments_only_of_visible_events(log):
    df = log(
        msg("m", "run", reasoning_content="think", tool_calls=[{"id": "c", "function": {"name": "f", "arguments": "{args}"}}, {"id": "d"}]),
        {"type": "tool.response", "id": "t", "thread_id": "sub-a", "content": "out"},
        {"type": "turn.created", "id": "x", "turn_id": "turn-1", "content": "hidden"},
        {"type": "user.message", "id": "u", "thread_id": MAIN, "content": "typed by a person"},
    )
    assert texts(df) == ["run\nthink\n{args}", "out"]
    assert e.main_text(e.merge_events(df)).first()["text"] == "run"
    assert e.visible_rows(e.merge_events(df), ("user.message",)).first()["text"] == "typed by a person"


def test_threads_and_sessions(log):
    df = log(
        {"type": "turn.created", "id": "t", "turn_id": "turn-1"}, msg("m1", "root"),
        {"type": "sandbox.created", "id": "b", "sandbox_id": "box-1"}, msg("m2", "sub", thread="sub-a"), delta("m2", "!", thread="sub-a"),
        {"type": "thread.done", "id": "d", "thread_id": "sub-a"}, {"type": "turn.created", "id": "t2", "turn_id": "turn-2"},
    )
    rows = {r["thread_id"]: r for r in e.thread_summary(df).collect()}
    assert {t for t, r in rows.items() if r["is_subagent"]} == {"sub-a"} and set(rows) == {"__turn__", "main", "sub-a"}
    assert rows["sub-a"]["done"] and not rows["main"]["done"]
    assert (rows["sub-a"]["raw_events"], rows["sub-a"]["merged_events"]) == (3, 2)
    assert tuple(e.session_summary(df).first()) == ("s", 6, "turn-2", "box-1")
    assert "sub!" in texts(df)


def test_reading_order(log):
    df = log(msg("b1", "1", thread="b"), msg("a1", "2", thread="a"), msg("b2", "3", thread="b"), msg("a2", "4", thread="a"))
    placed = e.reading_order(e.merge_events(df), block=1)
    rows = placed.orderBy("thread_first_seq", "first_seq").collect()
    assert [(r["id"], r["position"]) for r in rows] == [("b1", 1), ("b2", 2), ("a1", 1), ("a2", 2)]


def test_both_spellings_and_text_numbers(log):
    call = {"id": "c", "sourceEventId": "e", "function": {"name": "f", "arguments": "ARGS"}}
    df = log(
        {"type": "model.message", "id": "m", "threadId": "sub-x", "content": "hi", "reasoningContent": "why", "toolCalls": [call], "seq": "5"},
        {"type": "turn.created", "id": "t", "turnId": "turn-9", "seq": "12"}, {"type": "sandbox.created", "id": "b", "sandboxId": "box-9", "seq": 7},
    )
    assert texts(df) == ["hi\nwhy\nARGS"] and tuple(e.session_summary(df).first()) == ("s", 12, "turn-9", "box-9")
    row = e.merge_events(df).where("id = 'm'").first()
    assert (row["thread_id"], row["first_seq"], row["tool_calls"][0]["source_event_id"]) == ("sub-x", 5, "e")


def test_deltas_without_numbers_are_all_kept(log):
    df = log(msg("m", "a", seq=None), delta("m", "12", seq=None), delta("m", "12", seq=None))
    assert sorted(texts(df)[0].replace("\n", "")) == sorted("a1212")
    assert texts(log(msg("m", "a"), delta("m", "12"), delta("m", "12"))) == ["a1212"]


def plainly_folded(events):
    """Repeats never lose text and never double it; deltas are appended."""
    kept = ""
    for is_delta, text in events:
        if is_delta:
            kept += text
        elif not kept or kept in text:
            kept = text
        elif text and text not in kept:
            kept = text + "\n" + kept
    return kept


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repeats_and_deltas_match_a_plain_fold(spark, tmp_path, block):
    rng = random.Random(block)
    rows, want = [], {}
    for m in range(150):
        events = [(rng.random() < 0.5, rng.choice(["", "a", "b", "ab", "ba", "abab", "é", "x" * 9])) for _ in range(rng.randint(1, 14))]
        want[f"m{m}"] = plainly_folded(events), plainly_folded([(d, t[::-1]) for d, t in events])
        for seq, (is_delta, text) in enumerate(events):
            make = delta if is_delta else msg
            rows.append(json.dumps({"session_id": "s", "seq": m * 100 + seq, **make(f"m{m}", text, reasoning_content=text[::-1])}))
    rng.shuffle(rows)
    (tmp_path / "log.json").write_text("\n".join(rows))
    merged = e.merge_events(read_event_log(spark, str(tmp_path / "log.json")), block=block).collect()
    assert {r["id"]: (r["text"], r["reasoning"]) for r in merged} == want


def test_a_hundred_thousand_repeats_of_one_message(spark):
    """Two long texts by turns, each with a delta behind it: a fold that searches the text so far would take hours."""
    n = 100_000
    log = spark.range(n).select(
        F.lit("s").alias("session_id"), F.lit(MAIN).alias("thread_id"), F.lit("m").alias("id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 2 == 0, "model.message").otherwise("model.message.delta").alias("type"),
        F.expr("to_variant_object(named_struct('text', if(id % 2 = 0, repeat(if(id % 4 = 0, 'left ', 'right '), 200), '.')))").alias("content"),
        F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast(
            "array<struct<id:string,source_event_id:string,function:struct<name:string,arguments:string>>>"
        ).alias("tool_calls"),
    )
    row = e.merge_events(log).select("text").first()
    assert row["text"] == "right " * 200 + "\n" + "left " * 200 + "." * (n // 2)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_call_arguments_are_appended_by_call(log, block):
    def calls(*pieces):
        return [{"id": i, "function": {"name": "f", "arguments": text}} for i, text in pieces]

    df = log(
        msg("m", "", tool_calls=calls(("c1", "id 917-30"), ("c2", "x"))), delta("m", "", tool_calls=calls(("c1", "-5521"))),
        delta("m", "", tool_calls=calls(("c2", "y"), ("c3", "z"))),
    )
    assert texts(df, block=block) == ["id 917-30-5521\nxy\nz"]


def test_unreadable_lines_make_a_scan_incomplete(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"session_id":"s","seq":1,"id":"a","type":"model.message"}\n{"session_id":"s","seq":2,"id"\n[1]\n')
    log = read_event_log(spark, str(tmp_path))
    rows = {r["session_id"]: (r["malformed"], r["complete"]) for r in e.sequence_gaps(log).collect()}
    assert rows["s"] == (0, True) and not all(complete for _, complete in rows.values())


def test_sequence_numbers(spark):
    df = spark.createDataFrame([("5",), ("9",), ("x",), (None,), ("NaN",), ("1e400",)], "v string")
    assert [r[0] for r in df.select(parse_sequence(F.col("v"))).collect()] == [5, 9, None, None, None, None]


def test_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", 1), ("b", 3)], "session_id string, seq long")
    rows = {r["session_id"]: r for r in e.sequence_gaps(df).collect()}
    assert rows["a"]["complete"] and rows["a"]["duplicates"] == 1
    assert not rows["b"]["complete"] and rows["b"]["missing"] == 1


def tool(id, payload):
    return {"type": "tool.response", "id": id, "thread_id": MAIN, "content": payload if isinstance(payload, str) else json.dumps(payload)}


def test_exec_results(log):
    df = log(
        tool("1", {"success": True, "response": {"exitCode": 0, "result": "out"}}),
        tool("2", {"success": True, "response": {"exitCode": 1, "result": "boom"}}), tool("3", {"success": False}), tool("4", "not json"),
        tool("5", "42"), tool("6", "null"), tool("7", {"success": "true", "response": {"exitCode": "0"}}),
        {"type": "tool.response", "id": "8", "thread_id": MAIN, "content": [{"text": "{}"}]}, msg("9", '{"success":true}'),
    )
    results = e.exec_results(e.merge_events(df))
    rows = {r["id"]: (r["success"], r["exit_code"], r["output"]) for r in results.collect()}
    assert rows == {
        "1": (True, 0, "out"), "2": (True, 1, "boom"), "3": (False, None, ""), "5": (False, None, ""), "7": (False, None, ""),
    }
    failures = e.exec_failures(results)
    assert "output" not in failures.columns
    assert {r["id"]: (r["exit_code"], r["output_chars"]) for r in failures.collect()} == {"2": (1, 4), "3": (None, 0), "5": (None, 0), "7": (None, 0)}


@pytest.mark.parametrize(
    ("text", "objects"),
    [
        ('{"a":1}', [{"a": 1}]), ('{"a":1}\n{"b":2}', [{"a": 1}, {"b": 2}]), ('{"a":"}{"}', [{"a": "}{"}]),
        (r'{"a":"say \"hi\""}', [{"a": 'say "hi"'}]), (r'{"p":"C:\\"}', [{"p": "C:\\"}]), ('{"a":{"b":{"c":1}}}', [{"a": {"b": {"c": 1}}}]),
        ('wrote /x\n{"a":1}\nDone.', [{"a": 1}]), ('{"a":1', []), ('}{"a":1}', [{"a": 1}]), ("", []), ('{not json {"a":1}}', []),
        ('open " quote {"a":1}', []), ("{'a':1} {\"b\":2}", [{"b": 2}]),
    ],
)
def test_embedded_objects(spark, text, objects):
    df = spark.createDataFrame([(1, text)], "id int, out string")
    rows = e.embedded_payloads(df, ["id"], "out").orderBy("ordinal").collect()
    assert [json.loads(r["payload"]) for r in rows] == objects


GOOD = {"check": "scrub", "schema_version": 1, "run_id": "r", "passed": True, "row_count": 3, "columns": [], "surviving_identifier_columns": [], "canary_present": None}


@pytest.mark.parametrize(
    ("payload", "kind", "reason"),
    [
        (GOOD, "verification", None), ({**GOOD, "run_id": "old"}, "verification", "other run"), ({**GOOD, "schema_version": 2}, "verification", "schema version"),
        ({**GOOD, "passed": "true"}, "verification", "malformed"), ({k: x for k, x in GOOD.items() if k != "canary_present"}, "verification", "malformed"),
        ({"check": "scrub", "passed": True}, "verification", "other run"),
        ({"schema_version": 1, "run_id": "r", "row_count": 1, "column_count": 1, "pii_columns": [], "columns": []}, "verdict", None),
        ({"run_id": "r", "primary": {"difference": -1.5, "t_statistic": -2, "p_value": 0.04}, "safety": {"chi2": 0.3, "p_value": 0.6}}, "analysis", None),
        ({"run_id": "r", "primary": {}}, "analysis", "malformed"), ({"hello": 1}, None, "unrecognised"),
    ],
)
def test_payloads_are_believed_only_in_full(spark, payload, kind, reason):
    df = spark.createDataFrame([("s", 0, json.dumps(payload))], "session_id string, ordinal int, payload string")
    row = e.judged_payloads(df, F.lit("r")).first()
    assert (row["kind"], row["reason"]) == (kind, reason)


def test_first_believed_payload_wins(spark):
    rows = [("s", i, json.dumps({**GOOD, "run_id": run, "row_count": i})) for i, run in enumerate(["old", "r", "r"])]
    judged = e.judged_payloads(spark.createDataFrame(rows, "session_id string, ordinal int, payload string"), F.lit("r"))
    assert json.loads(e.bound_payloads(judged, ["session_id"], ["ordinal"]).first()["payload"])["row_count"] == 1
    assert tuple(e.rejected_payloads(judged).first()) == ("verification", "other run", 1)


# --- approval ---


def asked(call="call-1", source="msg-1", tool="generate_final_report", arguments='{"title":"T"}'):
    return [
        {"type": "model.message", "id": "msg-1", "thread_id": MAIN, "tool_calls": [{"id": call, "function": {"name": tool, "arguments": arguments}}]},
        {"type": "tool.approval_required", "id": "evt-1", "thread_id": MAIN, "tool_calls": [{"id": "call-1", "source_event_id": source}]},
    ]


def decided(*allowed):
    return [
        {"type": "user.tool_approval", "id": f"call-{i}", "thread_id": MAIN, "approval": {"status": "allow"} if ok else {"status": "deny", "reason": f"fix {i}"}}
        for i, ok in enumerate(allowed)
    ]


@pytest.mark.parametrize(
    ("events", "arguments"),
    [(asked(), '{"title":"T"}'), (asked(source=None), '{"title":"T"}'), (asked(call="other"), '{"title":"T"}'),
     (asked(call="other", tool="x"), ""), (asked(source="elsewhere"), ""), (asked(call="other", source=None), '{"title":"T"}')],
)
def test_pending(log, events, arguments):
    row = a.pending_approvals(log(*events)).first()
    assert (row["tool_call_id"], row["thread_id"], row["arguments"]) == ("call-1", MAIN, arguments)


def test_nothing_pending(log):
    assert a.pending_approvals(log(msg("m", "done"))).count() == 0


@pytest.mark.parametrize(
    ("allowed", "runs"),
    [
        ([True], [(True, ["a"])]), ([False], [(False, ["fix 0"])]), ([False, False, True], [(True, ["fix 0", "fix 1"])]),
        ([False] * 4, [(False, ["fix 0", "fix 1", "fix 2", "fix 3"])]),
        ([False] * 5 + [True], [(False, ["fix 0", "fix 1", "fix 2", "fix 3"]), (True, ["fix 4"])]),
        ([True, False, True, True], [(True, []), (True, ["fix 1"]), (True, [])]),
    ],
)
def test_outcomes_per_run(log, allowed, runs):
    rows = a.approval_outcomes(a.decisions(log(*decided(*allowed)))).orderBy("run").collect()
    runs = [(ok, [d for d in denials if d != "a"]) for ok, denials in runs]
    assert [(r["approved"], r["denials"]) for r in rows] == runs
    assert [r["rounds"] for r in rows] == [len(d) + ok for ok, d in runs]
    assert [r["exhausted"] for r in rows] == [not ok and len(d) == 4 for ok, d in runs]


def test_decided_calls_are_not_pending(log):
    deny = {"type": "user.tool_approval", "id": "call-1", "thread_id": MAIN, "approval": {"status": "deny", "reason": "no"}}
    again = {"type": "tool.approval_required", "id": "evt-2", "thread_id": MAIN, "tool_calls": [{"id": "call-2"}]}
    assert a.pending_approvals(log(*asked(), deny)).count() == 0
    row = a.pending_approvals(log(*asked(), deny, again)).first()
    assert (row["tool_call_id"], row["arguments"]) == ("call-2", '{"title":"T"}')
    early = {"type": "tool.approval_required", "id": "evt-3", "thread_id": "late", "tool_calls": [{"id": "call-3"}], "seq": 50}
    late = {"type": "tool.approval_required", "id": "evt-4", "thread_id": MAIN, "tool_calls": [{"id": "call-4"}], "seq": 60}
    assert a.pending_approvals(log(msg("m", "x"), early, late)).first()["tool_call_id"] == "call-4"


def test_reconciliation(spark, log, tmp_path):
    from cloakstone.sources.tables import append_release

    path = str(tmp_path / "released")
    for session, at in (("denied", 9), ("ok", 9), ("nobody", 1), ("twice", 5), ("twice", 6), ("early", 0), ("two", 2), ("two", 3)):
        append_release(spark, path, session, at, "T", "S")
    outcomes = None
    for session, allowed in (("denied", [0]), ("ok", [1]), ("forgotten", [1]), ("twice", [1]), ("early", [0, 1]), ("two", [1, 0, 1])):
        row = a.approval_outcomes(a.decisions(log(*decided(*allowed), session=session)))
        outcomes = row if outcomes is None else outcomes.union(row)
    found = a.reconcile_releases(outcomes, spark.read.parquet(path))
    assert {r["session_id"]: (r["without_approval"], r["not_released"]) for r in found.collect()} == {
        "denied": (1, 0), "nobody": (1, 0), "forgotten": (0, 1), "twice": (1, 0), "early": (1, 1),
    }


def test_every_approval_is_released(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.01"
    outcomes = contract.queries()["approval_outcome"](spark, folder).where("approved").collect()
    rows = contract.queries()["releases_of_approvals"](spark, folder).collect()
    assert len(rows) > 3 and all(r["reconciled"] for r in rows)
    assert sorted((r["session_id"], r["at"]) for r in rows) == sorted((r["session_id"], r["decided"] + 1) for r in outcomes)


# --- releases published once ---


def some_releases(spark, *rows):
    kind = "session_id string, decided long, at long, title string, summary string"
    return spark.createDataFrame([(s, d, d + 1, t, "text") for s, d, t in rows], kind)


def test_releases_are_published_once(spark, tmp_path):
    from cloakstone.sources import releases

    path = str(tmp_path / "releases")
    assert releases.released(spark, path).count() == 0
    one, both = some_releases(spark, ("a", 1, "A")), some_releases(spark, ("a", 1, "other"), ("b", 2, "B"), ("b", 5, "B2"))
    releases.stage(both, path)
    assert releases.released(spark, path).count() == 0  # written, but nobody published it
    first, second = releases.stage(one, path), releases.stage(both, path)
    assert releases.publish(spark, path, "t1", first) and releases.publish(spark, path, "t2", second)
    assert not releases.publish(spark, path, "t1", second)  # a retry of t1
    assert not releases.release(both, path, "t2")
    rows = sorted((r["session_id"], r["decided"], r["title"]) for r in releases.released(spark, path).collect())
    assert rows == [("a", 1, "A"), ("b", 2, "B"), ("b", 5, "B2")]  # of two, the one published first
    assert releases.release(some_releases(spark, ("a", 1, "again"), ("c", 3, "C")), path, "t3")
    rows = sorted((r["session_id"], r["decided"], r["title"]) for r in releases.released(spark, path).collect())
    assert rows == [("a", 1, "A"), ("b", 2, "B"), ("b", 5, "B2"), ("c", 3, "C")]
    assert not [p for p in (tmp_path / "releases/commits").iterdir() if "draft" in p.name and not p.name.startswith(".")]


def test_of_several_writers_of_one_name_the_first_publishes(spark, tmp_path):
    from cloakstone.sources import releases

    path = str(tmp_path / "releases")
    attempts = [releases.stage(some_releases(spark, ("a", 1, f"try {i}")), path) for i in range(3)]
    assert [releases.publish(spark, path, "same", attempt) for attempt in attempts] == [True, False, False]
    assert [r["title"] for r in releases.released(spark, path).collect()] == ["try 0"]


# --- payloads as table functions ---

AWKWARD = 'a {"x": "}\\\\"} b } {"y": {"z": "\\"{"}, "é": "\\u007b"} "{" {broken {"in": 1} "open { string'


def test_scanner_goes_on_at_every_split():
    from cloakstone.operators.payload_table import BraceScanner

    whole = list(e._balanced(AWKWARD, e.re.compile(e._TOKEN, e.re.DOTALL)))
    assert len(whole) == 2 and list(BraceScanner().feed(AWKWARD)) == whole
    for at in range(len(AWKWARD) + 1):
        for pieces in ([AWKWARD[:at], AWKWARD[at:]], [AWKWARD[:at], "", AWKWARD[at : at + 1], AWKWARD[at + 1 :]]):
            scanner = BraceScanner()
            assert [p for piece in pieces for p in scanner.feed(piece)] == whole, at
    scanner = BraceScanner()
    assert [p for c in AWKWARD for p in scanner.feed(c)] == whole


def test_payloads_as_table_functions(spark):
    from cloakstone.operators import payload_table

    payload_table.register(spark)
    texts = spark.createDataFrame([(1, AWKWARD), (2, None), (3, "none"), (4, '{"k":1}{"k":2}')], "n int, text string")
    rows = spark.sql("SELECT n, p.* FROM {t}, LATERAL payloads_of(text) p", t=texts).collect()
    assert {(r["n"], r["ordinal"]) for r in rows} == {(1, 0), (1, 1), (4, 0), (4, 1)}
    cut = [("a", i, c) for i, c in enumerate(AWKWARD)] + [("b", 2, '":1}'), ("b", 1, '{"k'), ("c", 0, None), ("c", 1, "{no json}")]
    pieces = spark.createDataFrame(cut, "key string, seq int, text string").repartition(5)
    got = sorted((r["key"], r["ordinal"], r["payload"]) for r in payload_table.payloads_over(pieces).collect())
    assert [g[:2] for g in got] == [("a", 0), ("a", 1), ("b", 0)] and got[2][2] == '{"k":1}'
