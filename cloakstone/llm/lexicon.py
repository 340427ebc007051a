"""A minimal acyclic transducer from byte strings to lists of numbers, stepped for many strings at once.

Sorted words are added one by one; states whose future is settled are merged with an equal one, so
suffixes are shared.  Numbers cannot sit in shared states, so they go on the edges: an edge carries how
many words lie before its branch, and the edges of a path add up to the place of its word in the sorted
list, which selects the word's outputs.  Edges live in one displaced table (state's base plus byte), so
a step of all strings is a few array lookups.  The arrays are one string of bytes, mapped, not parsed.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

NAMES = ("base", "final", "owner", "target", "skipped", "offsets", "outputs")


def _states(words: list[bytes]) -> tuple[list[tuple], list[bool], int]:
    """Edges and final marks of the minimal states, and the first state; ``words`` ascend, no two are equal."""
    register: dict[tuple, int] = {}
    edges: list[tuple] = []
    finals: list[bool] = []

    def settled(final: bool, out: list[tuple[int, int]]) -> int:
        signature = (final, tuple(out))
        known = register.get(signature)
        if known is None:
            known = register[signature] = len(edges)
            edges.append(signature[1])
            finals.append(final)
        return known

    # The path of the last word: per depth whether a word ends there, and the settled edges.
    ends, outs, last = [False], [[]], b""

    def shorten(depth: int) -> None:
        while len(ends) > depth + 1:
            state = settled(ends.pop(), outs.pop())
            outs[-1].append((last[len(ends) - 1], state))

    for word in words:
        common = 0
        for a, b in zip(word, last, strict=False):
            if a != b:
                break
            common += 1
        shorten(common)
        for _ in word[common:]:
            ends.append(False)
            outs.append([])
        ends[-1] = True
        last = word
    shorten(0)
    return edges, finals, settled(ends[0], outs[0])


def compiled(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The transducer of distinct words and their outputs, as bytes for :class:`Lexicon`."""
    order = sorted(range(len(words)), key=words.__getitem__)
    edges, finals, start = _states([words[i] for i in order])
    below = np.zeros(len(edges), np.int64)  # words that can still be spelled from a state
    for state, out in enumerate(edges):  # targets are settled before their states
        below[state] = finals[state] + sum(below[t] for _, t in out)
    total = sum(map(len, edges))
    base = np.zeros(len(edges), np.int32)
    free = np.ones(256 + 2 * total + 512, bool)
    branching = sorted((s for s in range(len(edges)) if len(edges[s]) > 1), key=lambda s: -len(edges[s]))
    low = 0
    for state in branching:
        first = edges[state][0][0]
        needed = [b - first for b, _ in edges[state]]
        while not free[low]:
            low += 1
        spot = max(low, first)
        tries = 0
        while not all(free[spot + d] for d in needed):
            spot += 1
            tries += 1
            if spot + 256 >= len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
        if tries > 64:  # crowded: later states begin their search further up
            low = max(low, spot - 64)
        base[state] = spot - first
        for d in needed:
            free[spot + d] = False
    single = np.array([s for s in range(len(edges)) if len(edges[s]) == 1], np.int64)
    if len(single):
        byte = np.array([edges[s][0][0] for s in single])
        places = np.flatnonzero(free[255:]) + 255
        while len(places) < len(single):
            free = np.concatenate([free, np.ones(len(free), bool)])
            places = np.flatnonzero(free[255:]) + 255
        base[single] = places[: len(single)] - byte
    size = int(base.max(initial=0)) + 257
    owner, target, skipped = (np.full(size, fill, np.int32) for fill in (-1, 0, 0))
    for state, out in enumerate(edges):
        before = int(finals[state])
        for byte, to in out:
            slot = base[state] + byte
            owner[slot], target[slot], skipped[slot] = state, to, before
            before += int(below[to])
    listed = [outputs[i] for i in order]
    offsets = np.cumsum([0, *map(len, listed)]).astype(np.int64)
    flat = np.array([n for out in listed for n in out], np.int32)
    # The first state is renamed to the last one's number by a header; arrays follow, eight bytes apart.
    arrays = [base, np.array(finals, np.int32), owner, target, skipped, offsets, flat]
    head = np.array([start, *map(len, arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled transducer, mapped into memory."""

    def __init__(self, content: bytes) -> None:
        # A file without a name: the pages can be dropped and read again, and nothing is left behind.
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            self._map = mmap.mmap(file.fileno(), os.fstat(file.fileno()).st_size, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, np.int64, 1 + len(NAMES))
        self.start, at = int(head[0]), head.nbytes
        for name, size in zip(NAMES, head[1:], strict=True):
            array = np.frombuffer(self._map, np.int64 if name == "offsets" else np.int32, int(size), at)
            setattr(self, name, array)
            at += array.nbytes + -array.nbytes % 8

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each span of bytes in the sorted words, -1 for other spans."""
        found = np.full(len(starts), -1, np.int64)
        alive = np.arange(len(starts))
        at, left = starts, ends - starts
        state, place = np.full(len(starts), self.start, np.int32), np.zeros(len(starts), np.int32)
        while len(alive):
            done = left == 0
            if done.any():
                accepted = done & (self.final[state] != 0)
                found[alive[accepted]] = place[accepted]
                going = ~done
                alive, at, left, state, place = alive[going], at[going], left[going], state[going], place[going]
            slot = self.base[state] + data[at]
            fits = self.owner[slot] == state
            if not fits.all():
                alive, at, left, slot, place = alive[fits], at[fits], left[fits], slot[fits], place[fits]
            state, place = self.target[slot], place + self.skipped[slot]
            at, left = at + 1, left - 1
        return found
