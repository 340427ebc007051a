from __future__ import annotations

import json

import pytest

from cloakstone.sources.paged import PagedReader, Pages, dealt, events_of, read_paged_history, stream_paged_history, write_pages


def page(folder, session, number, *seqs):
    target = folder / f"session_id={session}" / f"page={number}"
    target.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"seq": n, "id": f"e{n}", "type": "model.message", "content": f"text {n}"}) for n in seqs]
    (target / "part.json").write_text("\n".join(lines))


@pytest.fixture()
def history(tmp_path):
    page(tmp_path, "a", 0, 9, 8, 7)
    page(tmp_path, "a", 1, 6, 5, 3)
    page(tmp_path, "a", 2, 2, 1, None)
    page(tmp_path, "b", 0, 4)
    return tmp_path


def test_order_from_any_offset(history):
    pages = Pages(str(history))
    folder = pages.sessions()["a"]
    numbers = [1, 2, 3, 5, 6, 7, 8, 9]
    assert [n for n, _ in events_of(pages, folder, None, None)] == [None, *numbers]
    for since in range(11):
        assert [n for n, _ in events_of(pages, folder, since, None)] == [n for n in numbers if n > since]
        assert [n for n, _ in events_of(pages, folder, since, 6)] == [n for n in numbers if since < n <= 6]


def test_only_the_pages_needed_are_read(history, monkeypatch):
    pages, read = Pages(str(history)), []
    lines = Pages.lines
    monkeypatch.setattr(Pages, "lines", lambda self, p: read.append(p[-6:]) or lines(self, p))
    list(events_of(pages, pages.sessions()["a"], 7, None))
    assert set(read) == {"page=0"}


def test_a_missing_page_is_an_error(spark, history):
    (history / "session_id=a" / "page=1" / "part.json").unlink()
    (history / "session_id=a" / "page=1").rmdir()
    with pytest.raises(Exception, match="pages are missing"):
        read_paged_history(spark, str(history)).collect()


def test_batch_and_stream(spark, history, tmp_path):
    rows = read_paged_history(spark, str(history)).collect()
    assert sorted((r["session_id"], r["seq"] or 0) for r in rows) == [("a", 0)] + [("a", n) for n in (1, 2, 3, 5, 6, 7, 8, 9)] + [("b", 4)]
    assert not any(r["malformed"] for r in rows)
    assert {r["seq"] for r in read_paged_history(spark, str(history), 6).collect()} == {7, 8, 9}
    out, checkpoint = str(tmp_path.parent / "paged-out"), str(tmp_path.parent / "paged-checkpoint")

    def run():
        stream = stream_paged_history(spark, str(history)).select("session_id", "seq")
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert run() == [("a", n) for n in (1, 2, 3, 5, 6, 7, 8, 9)] + [("b", 4)]
    page(history, "b", 1, 4)  # a new event pushes the old one to the next page
    page(history, "b", 0, 11, 10)
    assert run() == [("a", n) for n in (1, 2, 3, 5, 6, 7, 8, 9)] + [("b", 4), ("b", 10), ("b", 11)]


def test_written_pages_are_newest_first(spark, tmp_path):
    log = spark.createDataFrame([("s", n, f"e{n}", "t") for n in range(25)], "session_id string, seq long, id string, type string")
    write_pages(log, str(tmp_path / "log"), 10)
    pages = Pages(str(tmp_path / "log"))
    folder = pages.sessions()["s"]
    assert [[n for n, _ in pages.lines(p)] for p in pages.pages(folder)] == [list(range(24, 14, -1)), list(range(14, 4, -1)), [4, 3, 2, 1, 0]]


def test_many_sessions_share_partitions_and_list_the_root_once(tmp_path, monkeypatch):
    for number in range(1500):
        page(tmp_path, f"s{number:04}", 0, number + 2, number + 1)
    reader = PagedReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) <= 64 and sorted(s for p in parts for s, _, _ in p.sessions) == [f"s{n:04}" for n in range(1500)]
    assert len(dealt([(str(n), None, None) for n in range(100_000)])) == 391
    monkeypatch.setattr(Pages, "sessions", lambda self: pytest.fail("a task lists the root"))
    assert [(s, n) for p in parts for s, n, _ in reader.read(p)] == [(f"s{k:04}", n) for k in range(1500) for n in (k + 1, k + 2)]


def test_a_page_is_one_file_and_odd_names_come_back(spark, tmp_path):
    log = spark.createDataFrame(
        [(s, n, f"e{n}", "t") for s in ("a", "b/c d", "", None) for n in (1, 2, 3)], "session_id string, seq long, id string, type string"
    )
    path = str(tmp_path / "log")
    write_pages(log, path, 2)
    # Folders are named as Spark names a partition's.
    names = ["__HIVE_DEFAULT_PARTITION__", "a", "b%2Fc d"]
    assert sorted(Pages(path).sessions()) == names
    assert [[f.name for f in p.iterdir()] for p in sorted((tmp_path / "log").glob("session_id=a/page=*"))] == [["part.json"], ["part.json"]]
    assert sorted((r["session_id"], r["seq"]) for r in read_paged_history(spark, path).collect()) == sorted(
        (s, n) for s in (names[0], *names) for n in (1, 2, 3)
    )
    with pytest.raises(Exception, match="already"):
        write_pages(log, path, 2)
