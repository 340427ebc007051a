"""Conversation repair: the cheapest edits that make a conversation an optional system turn and user/assistant pairs.

Rows are dealt by conversation and sorted by turn, last row first; a ``mapInPandas`` pass carries the
dynamic program over Arrow batches.  Its state is the cost of finishing the conversation from each of four
places in the pattern (nothing yet, behind ``s``, behind ``u``, behind ``a``); a row replaces it
and leaves one back pointer of 16 bits: for each place, how many turns to insert and what to do with the row.
Read forwards, the pointers are the edits.  Because every edit leads to one place, taking the least letter among
the cheapest at each step gives the least string.  Pointers and texts of a conversation beyond ``spill``
bytes go to a temporary file, so a task holds one Arrow batch and a few buffers however long the conversation; a lost
task repeats its conversations from the shuffle.

Rows are ordered by turn (nulls first), then role, then text.  Copies are found by a window over (conversation,
role, text), which sorts and spills like the rest.  Nulls of any column read as one blank.  A conversation
whose rows are all ``dropped`` keeps its line in the report.  Roles count by their first character; others than
``s``, ``u``, ``a`` fit nowhere and cost an edit.  Repeated rows are duplicates; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakstone.llm.common import BLANKS

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs; an undeleted unfinished row adds the last
EDITS = "DKR"  # what can be done with a row, least letter first; I stands between D and K
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEEDED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # where an inserted or renamed turn leads
ROLE_OF = {AFTER_U: "user", AFTER_A: "assistant"}
KEPT = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None)}
FINE, CUT_SHORT, GONE = range(3)  # what the faults leave possible

REPORT = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by CRC-32 of ``conv_id:turn`` modulo 20; dropped rows stay, marked."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    harm = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"), (harm == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")


def prepared(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """Rows dealt by conversation with their faults, the last row of each conversation first.

    ``dropped`` names a boolean column that marks rows to be passed over.

    One exchange on the conversation serves the window of copies and the final order.
    """
    have = F.coalesce(dropped, F.lit(False)) if dropped else F.lit(False)
    clean = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        have.alias("dropped"),
    ).select("conv_id", "dropped", *[F.when(~F.col("dropped"), F.col(c)).alias(c) for c in ("turn", "role", "text")])
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return (
        clean.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumn("fault", F.coalesce(fault, F.lit("")))
        .sortWithinPartitions("conv_id", "dropped", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth"))
        # Numbers travel as text: pandas would turn a column with a null into doubles.
        .select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "dropped", "fault")
    )


def _settled(costs: list[int], role: str, state: int) -> tuple[list[int], int]:
    """Costs of finishing from each place before a row, given those behind it, and the row's back pointer."""
    extra = UNFINISHED if state == CUT_SHORT else 0
    first: list[tuple[int, int]] = []  # cheapest without inserting, and which edit
    for place in range(4):
        best, edit = costs[place] + DELETE, 0
        if state != GONE:
            to = KEPT.get(role, (None,) * 4)[place]
            if to is not None and costs[to] + KEEP + extra < best:
                best, edit = costs[to] + KEEP + extra, 1
            if costs[NEEDED[place]] + REROLE + extra < best:
                best, edit = costs[NEEDED[place]] + REROLE + extra, 2
        first.append((best, edit))
    out = [best for best, _ in first]
    for _ in range(2):  # two turns inserted in a row lead back to the same place
        out = [min(out[p], INSERT + out[NEEDED[p]]) for p in range(4)]
    pointer = 0
    for place in range(4):
        at, inserted = place, 0
        # An insertion goes before keeping and renaming of the same cost, but behind deleting.
        while out[at] < first[at][0] or (first[at][1] != 0 and INSERT + out[NEEDED[at]] == out[at]):
            at, inserted = NEEDED[at], inserted + 1
        pointer |= (inserted * 3 + first[at][1]) << (4 * place)
    return out, pointer


@lru_cache(maxsize=4096)
def _step(relative: tuple[int, ...], role: str, state: int) -> tuple[tuple[int, ...], int, int]:
    """The same on costs less their least one, of which there are few: next costs, what they lack, pointer."""
    costs, pointer = _settled(list(relative), role, state)
    least = min(costs)
    return tuple(c - least for c in costs), least, pointer


END_COSTS = (0, 2 * INSERT, INSERT, 0)  # an empty result is whole, and so is one behind ``a``


class Spool:
    """Bytes appended to a temporary file in pieces and read back from the end."""

    def __init__(self) -> None:
        self._file = tempfile.TemporaryFile()

    def append(self, piece: bytes) -> None:
        self._file.write(piece)

    def blocks_from_end(self, size: int) -> Iterator[bytes]:
        """Blocks of ``size`` bytes, the last one first; only the last to come may be shorter."""
        end = self._file.seek(0, 2)
        while end > 0:
            begin = max(0, end - size)
            self._file.seek(begin)
            yield self._file.read(end - begin)
            end = begin

    def close(self) -> None:
        self._file.close()


class Repair:
    """One conversation, fed from its last row to its first."""

    def __init__(self, spill: int) -> None:
        self.rows = self.cost = self.illegal = self.distinct = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.highest = self.lowest = self.later = None
        self.costs = END_COSTS
        self._spill = spill
        self._pointers, self._texts, self._sizes = [], [], []  # the newest rows
        self._spooled: tuple[Spool, Spool, Spool] | None = None
        self._held = 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.rows += 1
        if turn is not None:
            self.distinct += turn != self.lowest
            self.lowest = turn
            if self.highest is None:
                self.highest = turn
        initial = role[:1]
        if self.later is not None and (initial, self.later) not in (("s", "u"), ("u", "a"), ("a", "u")):
            self.illegal += 1
        self.later = initial
        if fault:
            self.faults[fault] += 1
        state = FINE if not fault else CUT_SHORT if fault == "truncated" else GONE
        self.costs, more, pointer = _step(self.costs, initial if initial in KEPT else "", state)
        self.cost += more
        self._pointers.append(pointer)
        named = role.encode()
        shown = b"" if state == GONE else len(named).to_bytes(4, "little") + named + text.encode()
        self._texts.append(shown)
        self._sizes.append(len(shown))
        self._held += len(shown) + 100
        if self._held > self._spill:
            self._flush()

    def _flush(self) -> None:
        if self._spooled is None:
            self._spooled = Spool(), Spool(), Spool()
        pointers, texts, sizes = self._spooled
        pointers.append(np.array(self._pointers, "<u2").tobytes())
        texts.append(b"".join(self._texts))
        sizes.append(np.array(self._sizes, "<i8").tobytes())
        self._pointers, self._texts, self._sizes, self._held = [], [], [], 0

    def _forward(self) -> Iterator[tuple[int, bytes]]:
        """Back pointer and text of each row, first row first."""
        yield from zip(reversed(self._pointers), reversed(self._texts), strict=True)
        if self._spooled is None:
            return
        pointers, texts, sizes = self._spooled
        blocks, held, upto = texts.blocks_from_end(1 << 20), b"", 0
        for some, lengths in zip(pointers.blocks_from_end(2 * 4096), sizes.blocks_from_end(8 * 4096), strict=True):
            entries = zip(np.frombuffer(some, "<u2").tolist()[::-1], np.frombuffer(lengths, "<i8").tolist()[::-1], strict=True)
            for pointer, length in entries:
                if length > upto:
                    parts, have = [held[:upto]], upto
                    while have < length:
                        parts.append(next(blocks))
                        have += len(parts[-1])
                    held, upto = b"".join(reversed(parts)), have
                yield pointer, held[upto - length : upto]
                upto -= length

    def edits(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) in order; deleted rows have neither role nor text."""
        place = START
        for pointer, shown in self._forward():
            todo = pointer >> (4 * place) & 15
            for _ in range(todo // 3):
                place = NEEDED[place]
                yield "I", ROLE_OF[place], ""
            edit = EDITS[todo % 3]
            if edit == "D":
                yield "D", None, None
                continue
            behind = 4 + int.from_bytes(shown[:4], "little")
            role, text = shown[4:behind].decode(), shown[behind:].decode()
            place = KEPT[role[:1]][place] if edit == "K" else NEEDED[place]
            yield edit, role if edit == "K" else ROLE_OF[place], text
        while place in (AFTER_S, AFTER_U):
            place = NEEDED[place]
            yield "I", ROLE_OF[place], ""

    def total(self) -> int:
        return self.cost + self.costs[START]

    def gaps(self) -> int:
        return 0 if self.highest is None else int(self.highest - self.lowest + 1 - self.distinct)

    def close(self) -> None:
        for spool in self._spooled or ():
            spool.close()


def _conversations(batches: Iterator[pd.DataFrame], spill: int) -> Iterator[tuple[object, Repair]]:
    """Finished conversations of a stream sorted by conversation; state is carried from batch to batch."""
    nothing = object()
    current, repair = nothing, None
    for batch in batches:
        names = ("conv_id", "dropped", "turn", "role", "text", "fault")
        for key, dropped, turn, role, text, fault in batch[[*names]].itertuples(index=False, name=None):
            if key != current or repair is None:
                if repair is not None:
                    yield current, repair
                    repair.close()
                current, repair = key, Repair(spill)
            if not dropped:
                repair.add(None if turn is None else int(turn), role, text, fault)
    if repair is not None:
        yield current, repair
        repair.close()


def report(rows: DataFrame, dropped: str | None = None, spill: int = 64 << 20) -> DataFrame:
    """Per conversation: gaps in the turns, faults, illegal neighbours, cost, the edits, digest of the result."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, repair in _conversations(batches, spill):
            digest, audit, first = hashlib.sha256(), [], True
            for edit, role, text in repair.edits():
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            faults = repair.faults
            out.append((
                key, repair.gaps(), faults["blank"], faults["duplicate"], faults["truncated"], repair.illegal, repair.total(),
                "".join(audit), digest.hexdigest(),
            ))
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [part.split()[0] for part in REPORT.split(", ")]
    return _as_before(prepared(rows, dropped).mapInPandas(judged, REPORT), rows)


def repaired(rows: DataFrame, dropped: str | None = None, spill: int = 64 << 20) -> DataFrame:
    """The repaired turns: ``conv_id``, ``position`` from 0, ``role``, ``text`` and the ``edit`` that made them."""

    def mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out, held = ["conv_id", "position", "role", "text", "edit"], [], 0
        for key, repair in _conversations(batches, spill):
            position = 0
            for edit, role, text in repair.edits():
                if edit == "D":
                    continue
                out.append((key, position, role, text, edit))
                position, held = position + 1, held + len(text)
                if len(out) >= 2000 or held > spill:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    schema = "conv_id string, position long, role string, text string, edit string"
    return _as_before(prepared(rows, dropped).mapInPandas(mended, schema), rows)


def _as_before(out: DataFrame, rows: DataFrame) -> DataFrame:
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
