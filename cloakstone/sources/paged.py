"""A paged event history as a Spark source: pages come newest first, rows go out oldest first.

A history lies in folders ``session_id=<id>/page=<n>``, page 0 the newest, each with JSON lines newest first,
as a listing of a service gives them.  A partition is a handful of sessions, read one after the other: the reader
walks a session's pages until one reaches back to the wanted number, then goes the same way back and hands rows out
in order, so it holds one page.  The root is listed once, by the planner; a task opens its sessions' folders by name.
All pages are walked: there is no limit beyond which a history is cut short, and a page
missing in the row is an error, because a history with a hole proves nothing.

Options: ``path``; ``since``, a number to resume behind (batch).  As a stream, the offset is the highest number
of each session, taken from its newest page; a batch reads what came after the offset before.  Rows without a number are
given by a batch read from the start only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

from cloakstone.sources.event_log import EVENT_SCHEMA, unified

SESSIONS = 256  # the most sessions of one partition
_ESCAPED = "\"#%'*/:=?\\{[]^\x7f"  # fixed value: what a folder's name cannot hold
SPREAD = 64  # partitions before one gets a second session


@dataclass
class SessionPart(InputPartition):
    """Sessions, each with the numbers to read behind and up to."""

    sessions: list[tuple[str, int | None, int | None]]


def dealt(sessions: list[tuple[str, int | None, int | None]]) -> list[SessionPart]:
    """Partitions of a few sessions each: a task for every session would cost more than its rows."""
    size = min(SESSIONS, max(1, -(-len(sessions) // SPREAD)))
    return [SessionPart(sessions[at : at + size]) for at in range(0, len(sessions), size)]


class Pages:
    """The files of a history, wherever pyarrow can read them."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        if "://" not in path:
            path = "file://" + path.removeprefix("file:")
        self.files, self.root = fs.FileSystem.from_uri(path)

    def _folders(self, folder: str, prefix: str) -> dict[str, str]:
        from pyarrow import fs

        listed = self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name.removeprefix(prefix): f.path for f in listed if f.base_name.startswith(prefix)}

    def sessions(self) -> dict[str, str]:
        return self._folders(self.root, "session_id=")

    def folder(self, session: str) -> str:
        return f"{self.root.rstrip('/')}/session_id={session}"

    def pages(self, folder: str) -> list[str]:
        """Page folders, the newest first."""
        found = {int(n): path for n, path in self._folders(folder, "page=").items()}
        if sorted(found) != list(range(len(found))):
            raise ValueError(f"pages are missing in {folder}")
        return [found[n] for n in range(len(found))]

    def lines(self, page: str) -> list[tuple[int | None, str]]:
        """Number and text of each event of a page, the newest first."""
        from pyarrow import fs

        out = []
        names = sorted(f.path for f in self.files.get_file_info(fs.FileSelector(page)) if f.base_name.endswith(".json"))
        for name in names:
            with self.files.open_input_stream(name) as stream:
                for line in stream.read().decode().splitlines():
                    seq = json.loads(line).get("seq")
                    out.append((None if seq is None else int(seq), line))
        return out

    def put(self, session: str | None, number: int, lines: list[str]) -> None:
        """Write a page: beside its place first, so a reader sees it whole or not at all."""
        folder = f"{self.folder(folder_name(session))}/page={number}"
        self.files.create_dir(folder, recursive=True)
        draft = f"{folder}/{uuid.uuid4().hex}.draft"
        with self.files.open_output_stream(draft) as stream:
            stream.write("".join(f"{line}\n" for line in lines).encode())
        # A null and an empty name share a folder, but no file.
        self.files.move(draft, f"{folder}/part{'' if session else '-null' if session is None else '-empty'}.json")


def folder_name(session: str | None) -> str:
    """A session's name as Spark writes it into a partition's folder."""
    if not session:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in session)


def events_of(pages: Pages, folder: str, since: int | None, upto: int | None) -> Iterator[tuple[int | None, str]]:
    """Events behind ``since`` up to ``upto``, the oldest first."""
    walked, last = pages.pages(folder), None
    if since is not None:
        for place, page in enumerate(walked):
            last = page, pages.lines(page)
            numbers = [n for n, _ in last[1] if n is not None]
            if numbers and min(numbers) <= since:
                walked = walked[: place + 1]
                break
    for page in reversed(walked):
        # The page the walk ended on is the first on the way back.
        lines, last = last[1] if last and last[0] == page else pages.lines(page), None
        for seq, line in reversed(lines):
            if seq is None and since is None and upto is None:
                yield seq, line
            elif seq is not None and (since is None or seq > since) and (upto is None or seq <= upto):
                yield seq, line


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, since = options["path"], options.get("since")
        self.since = None if since is None else int(since)

    def partitions(self) -> list[SessionPart]:
        return dealt([(s, self.since, None) for s in sorted(Pages(self.path).sessions())])

    def read(self, partition: SessionPart) -> Iterator[tuple]:
        pages = Pages(self.path)
        for session, since, upto in partition.sessions:
            for seq, line in events_of(pages, pages.folder(session), since, upto):
                yield session, seq, line


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages = Pages(self.path)
        newest = {}
        for session, folder in pages.sessions().items():
            numbers = [n for page in pages.pages(folder)[:1] for n, _ in pages.lines(page) if n is not None]
            if numbers:
                newest[session] = max(numbers)
        return newest

    def partitions(self, start: dict, end: dict) -> list[SessionPart]:
        return dealt([(s, start.get(s, -1), upto) for s, upto in sorted(end.items()) if upto > start.get(s, -1)])

    def read(self, partition: SessionPart) -> Iterator[tuple]:
        yield from PagedReader.read(self, partition)  # the same walk between two numbers


class PagedWriter(DataSourceArrowWriter):
    """Rows (session, page, line), sorted, as one file a page; a repeated task puts the same pages again."""

    def __init__(self, options: dict) -> None:
        from pyarrow import fs

        self.path = options["path"]
        pages = Pages(self.path)
        if pages.files.get_file_info(pages.root).type != fs.FileType.NotFound:
            raise ValueError(f"there is something at {self.path} already")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        pages, place, lines = Pages(self.path), None, []
        for batch in iterator:
            for *here, line in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if here != place and lines:
                    pages.put(*place, lines)
                    lines = []
                place = here
                lines.append(line)
        if lines:
            pages.put(*place, lines)
        return WriterCommitMessage()


class PagedHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return "session string, number bigint, line string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def writer(self, schema, overwrite: bool) -> PagedWriter:
        return PagedWriter(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def _parsed(rows: DataFrame) -> DataFrame:
    """Events of the lines; a line's session is that of its folder."""
    event = F.from_json("line", EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_unreadable"})
    events = rows.select("session", event.alias("e")).select("session", "e.*")
    return unified(events.withColumn("session_id", F.coalesce("session_id", "sessionId", "session")).drop("session"))


def read_paged_history(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Events of all sessions behind number ``since``; within a session in order."""
    spark.dataSource.register(PagedHistory)
    reader = spark.read.format("paged_history").option("path", path)
    return _parsed((reader if since is None else reader.option("since", str(since))).load())


def stream_paged_history(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PagedHistory)
    return _parsed(spark.readStream.format("paged_history").option("path", path).load())


def write_pages(log: DataFrame, path: str, size: int = 100) -> None:
    """A log as a paged history: per session pages of ``size`` events, newest first.

    Pages are many and small: they are dealt over all tasks, whatever their bytes, and each is one file opened once.
    """
    from pyspark.sql import Window

    newest = Window.partitionBy("session_id").orderBy(F.desc_nulls_first("seq"), "id", "type")
    placed = log.withColumn("place", F.row_number().over(newest) - 1).withColumn("page", F.floor(F.col("place") / size).cast("int"))
    spark = log.sparkSession
    spark.dataSource.register(PagedHistory)
    told = F.to_json(F.struct(*[c for c in log.columns if c != "session_id"])).alias("line")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_pages = placed.select("session_id", "page", "place", told).repartition(tasks, "session_id", "page").sortWithinPartitions("session_id", "page", "place")
    sorted_pages.drop("place").write.format("paged_history").option("path", path).mode("append").save()
