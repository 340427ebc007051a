from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from cloakstone.functions.text import fingerprint
from cloakstone.operators import events as e
from cloakstone.operators.values import containment_pairs
from cloakstone.sources.event_log import read_event_log, stream_event_log
from cloakstone.streaming import live_values, turns
from cloakstone.streaming.store import MESSAGE, Store


def put(folder, number, *rows, session="s"):
    """One file, one batch; an event's time is ``at`` seconds, its number by default."""
    folder.mkdir(exist_ok=True)
    file = folder / f"{number:03d}.json"
    rows = [{"session_id": session, "thread_id": "main", "turn_id": str(1 + (r["at"] if "at" in r else r.get("seq", 0))), **r} for r in rows]
    file.write_text("".join(json.dumps({k: v for k, v in r.items() if k != "at"}) + "\n" for r in rows))
    os.utime(file, (1_000_000_000 + number,) * 2)


def message(seq, text, id="m", **more):
    return {"seq": seq, "id": id, "type": "model.message", "content": text, **more}


def delta(seq, text, id="m", **more):
    return {"seq": seq, "id": id, "type": "model.message.delta", "content": text, **more}


def done(seq, **more):
    return {"seq": seq, "id": f"done-{seq}", "type": "turn.done", **more}


def clock(at):
    return {"seq": None, "id": "clock", "type": "clock", "session_id": "clock", "at": at}


@pytest.fixture()
def go(spark, tmp_path):
    """Stream a folder one file per batch, to the end; the turn id holds the time."""
    log, path = tmp_path / "log", str(tmp_path / "table")

    def run(**options):
        store = Store(spark, path, buckets=4, **options.pop("store", {}))
        stream = stream_event_log(spark, str(log), 1).withColumn("at", F.timestamp_seconds(F.col("turn_id").cast("bigint")))
        options = {"lateness": "10 seconds", "delay": "20 seconds", "idle": "1000 seconds", **options}
        query = turns.start_turns(stream, path, str(tmp_path / "checkpoint"), store=store, **options)
        query.awaitTermination()
        return store, query

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # every partition of every batch starts a worker
    yield run, log
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def texts(store, block=e.BLOCK):
    rows = turns.merged_messages(store, block).collect()
    return {(r["session_id"], r["thread_id"], r["id"]): (r["type"], r["text"], r["first_seq"], r["last_seq"]) for r in rows}


def batch_texts(spark, log, block=e.BLOCK):
    rows = e.merge_events(read_event_log(spark, str(log)), block).collect()
    return {(r["session_id"], r["thread_id"], r["id"]): (r["type"], r["text"], r["first_seq"], r["last_seq"]) for r in rows}


def gone(spark, store):
    return {r["id"] for r in turns.evicted(spark, store.path).collect()}


def rows_held(query):
    return [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress]


@pytest.mark.parametrize("block", [2, 4096])
def test_state_ends_after_the_turn_and_the_table_stays(spark, go, block):
    run, log = go
    put(log, 0, message(0, "one "), delta(1, "two "), message(2, "other", "n"))
    put(log, 1, delta(3, "three"), {"seq": 4, "id": "t", "type": "thread.done"}, clock(200))
    put(log, 2, message(5, "after", "o", at=201), done(6, at=202), clock(215))
    put(log, 3, message(7, "next turn", "p", at=220), clock(300))
    put(log, 4, message(8, "still there", "q", at=301), clock(310))
    store, query = run(block=block)
    assert texts(store, block) == batch_texts(spark, log, block)
    left = gone(spark, store)
    assert {"m", "n", "o", "t", "done-6"} <= left and not {"p", "q"} & left  # the thread's end alone evicted nothing before
    first = turns.evicted(spark, store.path).agg(F.min("batch")).first()[0]
    assert first >= 3


def test_a_message_continued_after_eviction_is_folded_whole(spark, go):
    run, log = go
    put(log, 0, message(0, "head "), done(5))
    put(log, 1, clock(100))
    put(log, 2, delta(1, "tail", at=101), clock(102))
    put(log, 3, delta(2, "!", at=103))
    seen = []
    store, _ = run(on_batch=lambda merged, n: seen.append((n, sorted(r["text"] for r in merged.collect() if r["id"] == "m"))))
    assert "m" in gone(spark, store)
    assert texts(store)[("s", "main", "m")] == batch_texts(spark, log)[("s", "main", "m")] == ("model.message", "head tail!", 0, 2)
    assert turns.merged_messages(store).where("id = 'm'").count() == 1


def test_touched_messages_are_whole_over_blocks_and_batches(spark, go):
    run, log = go
    put(log, 0, message(0, "id 917-30"), message(1, "x", "n"))
    put(log, 1, delta(2, "-55"), delta(3, "y", "n"))
    put(log, 2, delta(4, "21 end"), delta(4, "21 end"))
    seen = {}
    store, _ = run(block=2, store={"fanout": 2}, on_batch=lambda merged, n: seen.update({n: {r["id"]: r["text"] for r in merged.collect()}}))
    assert seen[0] == {"m": "id 917-30", "n": "x"}
    assert seen[1] == {"m": "id 917-30-55", "n": "xy"}
    assert seen[2] == {"m": "id 917-30-5521 end"}
    assert texts(store, 2) == batch_texts(spark, log, 2)


def test_resumed_and_repeated_batches_change_nothing(spark, go):
    run, log = go
    put(log, 0, message(0, "first"), {"id": "u", "type": "model.message", "content": "no number"})
    store, _ = run()
    put(log, 1, delta(1, " second"), {"id": "u", "type": "model.message", "content": "no number"})
    store, _ = run()
    want = batch_texts(spark, log)
    assert texts(store) == want
    kind = "session_id string, thread_id string, id string, block long, life long, rows string"
    line = store.versions().where("id = 'm'").select("session_id", "thread_id", "id", "block", "life", "rows").collect()
    store.write(spark.createDataFrame(line, kind), 1)  # the same batch once more
    assert store.manifest()["batch"] == 1 and texts(store)[("s", "main", "m")] == want[("s", "main", "m")]


def test_state_is_bounded_over_many_sessions(spark, go):
    run, log = go
    for number in range(8):
        time = number * 100
        rows = [dict(r, session_id=f"s{number}-{k}", at=time + 1) for k in range(20) for r in (message(0, "a"), delta(1, "b"), done(2))]
        put(log, number, *rows)
    store, query = run()
    held = rows_held(query)
    assert max(held) <= 2 * held[0] and held[-1] <= held[0]  # the rows of two batches at most, whatever the stream's length
    assert len(texts(store)) == 8 * 20 * 2
    assert len(gone(spark, store)) >= 2


def test_idle_groups_end_without_a_turn_end(spark, go):
    run, log = go
    put(log, 0, message(0, "breaks off"))
    put(log, 1, clock(500))
    put(log, 2, clock(600))
    put(log, 3, clock(610))
    store, _ = run(idle="50 seconds")
    assert "m" in gone(spark, store) and texts(store)[("s", "main", "m")][1] == "breaks off"


@pytest.mark.parametrize("block", [1, 3])  # 2 and 4096 stand in the tests of the merge
def test_live_values_are_those_of_the_batch_scan(spark, go, tmp_path, block):
    _, log = go
    long = "a very long value " * 12 + "end"
    put(log, 0, message(1, "a Marlow"), message(2, "nothing", "n"), message(3, long[:100], "o"), message(9, "orphan tail", "p", type="model.message.delta"))
    put(log, 1, delta(4, "e-Quint b, abc"), delta(5, long[100:170], "o"), {"seq": 6, "id": "n", "type": "model.message.delta", "reasoning_content": "Marlowe"})
    put(log, 2, delta(7, "de"), delta(8, long[170:] + "!", "o"), {"seq": 10, "id": "n", "type": "model.message.delta", "reasoning_content": "-Quint"})
    put(log, 3, message(0, "put before: secret ", "p"), delta(11, " more words without any value", "o"))
    values = spark.createDataFrame([(v,) for v in ("Marlowe-Quint", "abcde", long, "absent one", "secret", "abc")], "value string")
    stream = stream_event_log(spark, str(log), 1).withColumn("at", F.timestamp_seconds(F.col("turn_id").cast("bigint")))
    path = str(tmp_path / "live")
    live_values.start_live_values(stream, path, str(tmp_path / "checkpoint"), values, block=block, buckets=2).awaitTermination()
    got = {(r["text_id"], r["fingerprint"]) for r in live_values.found_values(spark, path).collect()}
    rows = live_values.channels(e.merge_events(read_event_log(spark, str(log)), block)).withColumn("text_id", F.concat_ws("/", *MESSAGE))
    batch = containment_pairs(rows, "text_id", "text", values).select("text_id", fingerprint(F.col("value")).alias("f"))
    assert got == {tuple(r) for r in batch.distinct().collect()} and len(got) == 5
    read = {r["batch"]: r["chars"] for r in live_values.characters_read(spark, path).collect()}
    assert read[3] < 2 * len(long) + 100  # of the long message only its end was compared again


# --- the store by itself ---


def versions(spark, batch, n, text="x"):
    rows = [(f"s{batch}", "main", f"m{i}", 0, 0, json.dumps({"seq": i, "text": text * 200})) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, thread_id string, id string, block long, life long, rows string")


def bytes_of(store, files):
    return sum(
        os.path.getsize(os.path.join(folder, f))
        for run, buckets in files.items() for b in buckets
        for folder in [f"{store.path}/runs/run={run}/bucket={b}"] for f in os.listdir(folder) if f.endswith(".parquet")
    )


def test_bytes_read_per_batch_do_not_grow(spark, tmp_path):
    store, read, sizes = Store(spark, str(tmp_path / "store"), buckets=4, fanout=3), [], []
    for batch in range(14):
        rows = versions(spark, batch, 60)
        before = versions(spark, batch - 1, 5, "y") if batch else rows.limit(0)  # some messages of the last batch go on
        closed = versions(spark, batch - 2, 60) if batch > 1 else None
        store.write(rows.union(before), batch, closed)
        files = store.files_for(before.union(rows), batch)
        read.append(bytes_of(store, files))
        found = store.lookup(before.union(rows), batch).collect()
        assert len(found) == 60 + before.count()
        assert all('"yyy' in r["rows"] for r in found if r["session_id"] == f"s{batch - 1}")
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet")))
    assert max(read[8:]) <= 1.5 * max(read[2:8])
    assert store.versions().count() == 14 * 60
    names = {r["name"] for r in store.manifest()["runs"]}
    there = {p.name.removeprefix("run=") for p in (tmp_path / "store/runs").iterdir()}
    retired = set(store.manifest()["retired"])
    assert names <= there <= names | retired and len(retired) < 14  # merged runs are deleted after a while
    assert len(names) < 10


def test_lookup_finds_all_and_reads_few(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=8, fanout=100)
    for batch in range(6):
        store.write(versions(spark, batch, 300), batch)
    wanted = versions(spark, 3, 300).limit(40)
    files = store.files_for(wanted)
    assert set(files) >= {"L0-3"} and sum(len(b) for run, b in files.items() if run != "L0-3") < 20
    got = {tuple(r[c] for c in MESSAGE) for r in store.lookup(wanted).collect()}
    assert got == {tuple(r[c] for c in MESSAGE) for r in wanted.collect()}
    strangers = spark.createDataFrame([("no", "such", f"m{i}") for i in range(3)], "session_id string, thread_id string, id string")
    assert store.lookup(strangers).count() == 0
    assert Store(spark, str(tmp_path / "empty")).lookup(wanted).count() == 0


# --- late rows ---


def test_late_rows_fail_the_verdict(spark, go, tmp_path):
    run, log = go
    listener = turns.Ledger(spark, str(tmp_path / "table"))
    spark.streams.addListener(listener)
    try:
        put(log, 0, message(0, "a", at=1000), delta(1, "b", at=1001))
        store, _ = run()
        listener.wait(store.manifest()["batch"])
        row = turns.verdict(store).first().asDict()
        assert (row["arrived"], row["taken"], row["late"], row["unaccounted"], row["passed"]) == (2, 2, 0, 0, True)
        put(log, 1, delta(2, "c", at=2000))
        put(log, 2, delta(3, "late", at=5), delta(4, "late too", "n", at=6), delta(5, "d", at=2001))
        store, _ = run()
        listener.wait(store.manifest()["batch"])
        row = turns.verdict(store).first().asDict()
        assert (row["arrived"], row["taken"], row["late"], row["unaccounted"], row["passed"]) == (6, 4, 2, 0, False)
        late = {r["batch"]: r["late"] for r in turns.ledger(spark, store.path, store.manifest()["batch"]).collect()}
        assert sum(late.values()) == 2 and sorted(late.values())[-1] == 2
    finally:
        spark.streams.removeListener(listener)


def test_an_unaccounted_batch_fails_the_verdict(spark, go, tmp_path):
    run, log = go
    put(log, 0, message(0, "a"))
    store, _ = run()  # nobody listens
    (tmp_path / "table/ledger").mkdir()
    row = turns.verdict(store).first()
    assert row["unaccounted"] > 0 and row["late"] == 0 and not row["passed"]
