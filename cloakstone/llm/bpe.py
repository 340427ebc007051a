"""BPE encoding and decoding with a public vocabulary of word pieces, through a compiled lexicon.

One pass counts the words of all texts; the ``words`` most frequent ones are merged once, in tasks, and
compiled into a minimal acyclic transducer whose outputs are their ids.  The second pass splits
whole texts with array work, steps all words of a slice through the mapped transducer at once, and
merges words it does not hold exactly, by rank, so the result is the vocabulary's own whatever the
lexicon holds.  ``words`` bounds the lexicon, which is the only thing sent to tasks besides the vocabulary.

The vocabulary is a file for the ``tokenizers`` library: its normaliser and its split pattern are asked
once per character and process (class, lower case); texts with characters that act on their
neighbours (marks, conjoining letters, characters Python does not know) are normalised by the library
whole.  Special tokens inside a text give their ids, as the library does.

Cases: a null text counts as empty and has no ids; white space alone likewise.  A very long word is
merged with a heap, in n log n steps.  Repeated rows are encoded alike; an empty table gives an empty lexicon
and result.  Other columns pass through untouched, whatever their names.  Ids unknown to the vocabulary are an
error in decoding.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakstone.llm import kernels as K
from cloakstone.llm.lexicon import Lexicon, compiled

LETTER, NUMBER, OTHER, SPACE, COMPLEX, UNSEEN = range(6)
# The endings that the split pattern keeps together with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
MOST_CACHED = 1 << 18  # words merged in a task that it remembers
SHORT = 64  # bytes; longer words are neither remembered nor compiled


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


class Splitter:
    """Cuts texts into the words of a vocabulary file, as UTF-8 spans of their normal form."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(vocabulary)
        self._normal = whole.normalizer
        self._pattern = whole.pre_tokenizer[0]
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.special = {t["content"]: t["id"] for t in json.loads(vocabulary)["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _kind(self, c: str) -> int:
        def first(text: str) -> tuple[int, int] | None:
            words = self._pattern.pre_tokenize_str(text)
            return words[0][1] if words else None

        if first("a" + c) == (0, 2):
            return LETTER
        if first("!" + c) == (0, 2):
            return OTHER
        return NUMBER if len(self._pattern.pre_tokenize_str("a" + c)) == 2 else SPACE

    def _learn(self, points: np.ndarray) -> None:
        for point in points.tolist():
            c = chr(point)
            kind = unicodedata.category(c)
            normal = self._normal.normalize_str(c)
            if kind[0] == "M" or kind == "Cn" or 0x1100 <= point < 0x1200 or len(normal) != 1:
                self.classes[point] = COMPLEX
                continue
            self.lower[point] = ord(normal)
            self.classes[point] = self._kind(normal)

    def _points(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        new = points[self.classes[points] == UNSEEN]
        if len(new):
            self._learn(np.unique(new))
        return points

    def _normalised(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points of one text in normal form, and their classes."""
        points = np.frombuffer(self._normal.normalize_str(text).encode("utf-32-le"), np.uint32)
        kinds = self.classes[points]
        for point in np.unique(points[kinds >= COMPLEX]).tolist():
            kinds[points == point] = self._kind(chr(point))
        return points, kinds

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the normal forms, start and end of each word in them, and its text."""
        size = np.array([len(t) + 1 for t in texts])
        points = self._points("\n".join(texts) + "\n" if texts else "")
        kinds, lowered = self.classes[points], self.lower[points]
        edge = np.concatenate([[0], np.cumsum(size)])
        of_complex = np.unique(np.searchsorted(edge, np.flatnonzero(kinds == COMPLEX), "right") - 1)
        if len(of_complex):
            parts, kept, from_ = [], [], 0
            for i in of_complex.tolist():
                own, own_kinds = self._normalised(texts[i])
                parts += [lowered[from_ : edge[i]], own, lowered[edge[i + 1] - 1 : edge[i + 1]]]
                kept += [kinds[from_ : edge[i]], own_kinds, kinds[edge[i + 1] - 1 : edge[i + 1]]]
                from_, size[i] = edge[i + 1], len(own) + 1
            lowered = np.concatenate([*parts, lowered[from_:]])
            kinds = np.concatenate([*kept, kinds[from_:]])
            edge = np.concatenate([[0], np.cumsum(size)])
        begin = self._starts(lowered, kinds)
        at = np.flatnonzero(begin)
        next_space = np.flatnonzero(kinds == SPACE)  # every text ends with one
        stop = next_space[np.searchsorted(next_space, at)] if len(at) else at
        end = np.minimum(stop, np.append(at[1:], len(kinds)))
        data = np.frombuffer(lowered.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        byte = np.concatenate([[0], np.cumsum(1 + (lowered >= 0x80) + (lowered >= 0x800) + (lowered >= 0x10000))])
        return data, byte[at], byte[end], np.searchsorted(edge, at, "right") - 1

    def _starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """True where a word begins: at a change of class, at every number, and behind an ending."""
        begin = kinds != SPACE
        begin[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        quotes = np.flatnonzero(begin & (points == 39))
        for ending in ENDINGS:
            hit = quotes[quotes + len(ending) < len(points)]
            for j, letter in enumerate(ending, 1):
                hit = hit[points[hit + j] == ord(letter)]
            begin[hit + 1] = False
            after = hit + len(ending) + 1
            after = after[after < len(points)]
            begin[after] = kinds[after] != SPACE
        return begin


class Merger:
    """Exact merges of one word by rank."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        self.rule = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rule[ids[left], ids[right]] = rank, ids[left + right]

    def merge(self, word: bytes) -> list[int]:
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(parts) > 48:
            return self._merge_long(parts)
        rule = self.rule
        while len(parts) > 1:
            best = min(((rule.get(pair, (1 << 60, 0))[0], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [rule[parts[i], parts[i + 1]][1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs and links between what is left."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (hit := self.rule.get((parts[i], parts[j]))):
                heapq.heappush(heap, (hit[0], i, parts[i], parts[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]


@dataclass(frozen=True)
class Coder:
    """What tasks need: the vocabulary file's content and the lexicon's bytes."""

    vocabulary: str
    lexicon: bytes | None = None


@lru_cache(maxsize=4)
def _splitter(vocabulary: str) -> Splitter:
    return Splitter(vocabulary)


@lru_cache(maxsize=4)
def _merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


@lru_cache(maxsize=2)
def _lexicon(content: bytes) -> Lexicon:
    return Lexicon(content)


@lru_cache(maxsize=4)
def _pieces(vocabulary: str) -> list[str]:
    read = json.loads(vocabulary)
    ids = {**read["model"]["vocab"], **{t["content"]: t["id"] for t in read["added_tokens"]}}
    pieces = [""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        pieces[i] = piece
    return pieces


class Encoder:
    """Ids of many texts: lexicon first, merges for the rest."""

    def __init__(self, coder: Coder) -> None:
        self.split, self.merge = _splitter(coder.vocabulary), _merger(coder.vocabulary).merge
        self.lexicon = _lexicon(coder.lexicon)
        self.cache: dict[bytes, list[int]] = {}

    def _merged(self, word: bytes) -> list[int]:
        known = self.cache.get(word)
        if known is None:
            known = self.merge(word)
            if len(word) <= SHORT and len(self.cache) < MOST_CACHED:
                self.cache[word] = known
        return known

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and where each text's begin; special tokens are ordinary text here."""
        data, begin, end, of = self.split.split(texts)
        place = self.lexicon.places(data, begin, end)
        offsets, flat = self.lexicon.offsets, self.lexicon.outputs
        missing = np.flatnonzero(place < 0)
        if len(missing):
            raw, own, extra = data.tobytes(), {}, []
            size = len(offsets) - 1
            for i in missing.tolist():
                word = raw[begin[i] : end[i]]
                number = own.get(word)
                if number is None:
                    number = own[word] = size + len(own)
                    extra.append(self._merged(word))
                place[i] = number
            offsets = np.concatenate([offsets, offsets[-1] + np.cumsum(list(map(len, extra)))])
            flat = np.concatenate([flat, np.array([n for ids in extra for n in ids], np.int32)])
        length = offsets[place + 1] - offsets[place]
        first = np.cumsum(length) - length
        ids = flat[np.repeat(offsets[place] - first, length) + np.arange(length.sum())]
        per_text = np.bincount(of, weights=length, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, special tokens found first."""
        cut = self.split.cut
        marked = [i for i, t in enumerate(texts) if cut and "<" in t and cut.search(t)] if cut else []
        if not marked:
            return self.plain(texts)
        pieces, owner, fixed = [], [], {}
        marked = set(marked)
        for i, text in enumerate(texts):
            for j, piece in enumerate(cut.split(text) if i in marked else [text]):
                if j % 2:
                    fixed[len(pieces)] = self.split.special[piece]
                    piece = ""
                pieces.append(piece)
                owner.append(i)
        ids, at = self.plain(pieces)
        where = np.array(list(fixed), np.int64)
        ids = np.insert(ids, at[where], np.array(list(fixed.values()), np.int32))
        size = np.diff(at)
        size[where] += 1
        per_text = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


_encoders: dict[int, Encoder] = {}


def _encoder(coder: Broadcast) -> Encoder:
    key = hash((coder.value.vocabulary, coder.value.lexicon))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(coder.value)
    return _encoders[key]


def _slices(column: pa.Array, limit: int = K.SLICE) -> Iterator[list[str]]:
    """Texts of a column, about ``limit`` bytes at a time; null is empty."""
    data, at = K.buffers(column)
    for piece, offsets in K.slices(data, at, limit):
        raw = piece.tobytes()
        yield [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def word_counts(texts: DataFrame, text: str, vocabulary: Broadcast) -> DataFrame:
    """How often each word (UTF-8 of its normal form) stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(vocabulary.value.vocabulary)
        for batch in batches:
            counted: Counter[bytes] = Counter()
            for part in _slices(batch.column(0)):
                if split.cut:
                    part = [piece for t in part for piece in (split.cut.split(t)[::2] if "<" in t else [t])]
                data, begin, end, _ = split.split(part)
                raw, hashes = data.tobytes(), K.span_hashes(data, begin, end)
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                # Two words of one hash in one slice count as the first: that moves a choice, not a result.
                for i, times in zip(first.tolist(), n.tolist(), strict=True):
                    counted[raw[begin[i] : end[i]]] += times
            words = [w for w in counted if len(w) <= SHORT]  # a longer word is merged where it stands
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([counted[w] for w in words], pa.int64())], names=["word", "n"]
            )

    counted = texts.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def merged_ids(word: Column, vocabulary: Broadcast) -> Column:
    @F.arrow_udf("array<int>")
    def merged(column: pa.Array) -> pa.Array:
        merge = _merger(vocabulary.value.vocabulary).merge
        return pa.array([merge(w) for w in column.to_pylist()], pa.list_(pa.int32()))

    return merged(word)


def build(texts: DataFrame, tokenizer: str, text: str = "text", words: int = 1 << 17) -> Broadcast:
    """Lexicon of the ``words`` most frequent words of ``texts``, ready for tasks; ``tokenizer`` is the vocabulary's path."""
    spark = texts.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = file.read()
    _checked(vocabulary)
    shared = spark.sparkContext.broadcast(Coder(vocabulary))
    frequent = word_counts(texts, text, shared).where("n > 1").orderBy(F.desc("n"), "word").limit(words)
    rows = frequent.select("word", merged_ids(F.col("word"), shared).alias("ids")).collect()
    lexicon = compiled([bytes(r["word"]) for r in rows], [r["ids"] for r in rows])
    return spark.sparkContext.broadcast(Coder(vocabulary, lexicon))


def _checked(vocabulary: str) -> None:
    """This module knows one kind of file: merges by rank over bytes, a mark at the word's end, no decoder."""
    read = json.loads(vocabulary)
    model, before = read["model"], read["pre_tokenizer"]["pretokenizers"]
    known = (
        model["type"] == "BPE" and model["end_of_word_suffix"] and not model["ignore_merges"] and model["dropout"] is None
        and read["decoder"] is None and [p["type"] for p in before] == ["Split", "ByteLevel"] and not before[1]["add_prefix_space"]
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"])
    )
    if not known:
        raise ValueError("not a vocabulary of byte pieces with word ends")


def encode(text: Column, coder: Broadcast) -> Column:
    """Ids of a column of whole texts, special tokens of the text included, none added."""

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        encoder, parts = _encoder(coder), []
        for part in _slices(column):
            ids, at = encoder.encode(part)
            parts.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encoded(text)


def _decoded(column: pa.Array, vocabulary: str) -> list[str]:
    pieces = np.array(_pieces(vocabulary), object)
    at = column.offsets.to_numpy()
    ids = column.values.to_numpy(zero_copy_only=False)
    return [" ".join(pieces[ids[a:b]].tolist()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def decode(ids: Column, coder: Broadcast) -> Column:
    """Texts of a column of ids as the library writes them: pieces with their word ends, a blank between."""

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array(_decoded(column, coder.value.vocabulary), pa.string())

    return decoded(ids)


def digests(ids: Column, coder: Broadcast) -> Column:
    """Number of ids, SHA-256 of them as little-endian 32-bit numbers, and of the decoded text, as one struct."""
    import hashlib

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(column: pa.Array) -> pa.Array:
        at = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).astype("<u4")
        spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        arrays = [
            pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in _decoded(column, coder.value.vocabulary)], pa.string()),
        ]
        return pa.StructArray.from_arrays(arrays, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digested(ids)


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", words: int = 1 << 17, ids: str = "ids") -> DataFrame:
    """The documents with their ids as a further column."""
    return docs.withColumn(ids, encode(F.col(text), build(docs, tokenizer, text, words)))

