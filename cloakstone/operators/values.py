"""Which dictionary values occur inside which texts, exactly, at any dictionary size.

Substring containment has no equi key, so a naive plan compares every text with every
value.  Here the texts are scanned once against a filter of *fixed* size, and what passes
is settled by an ordinary equi-join on the value itself:

1. Each value sets three bits for its head (its first 64 characters) in a bitmap, and marks its
   length at the slot of its first five characters in a table.  Spark combines both; only they,
   whose size is a parameter and not a property of the data, reach the driver and are broadcast.
2. Each text is hashed with a rolling polynomial, so the hash of any substring costs two
   look-ups.  The table names the few lengths worth testing at a position; heads of those
   lengths that the bitmap knows are emitted as ``(text id, substring, count)``.
3. A value of ``HEAD`` characters or more is a chain behind its head: blocks of ``TOP`` characters, then
   of ever smaller powers of two, each block's fingerprint keyed by the one before.  The bitmap
   knows which block sizes may follow a fingerprint and where a value ends, so the scan walks
   from a head as long as some value goes on like the text, and emits a digest of 32 bytes where one
   ends.  However long a value is, no text travels with a survivor.
4. The survivors are joined to the dictionary on the string or its digest.  The filter has no false
   negatives and the join no false positives, so the result is exact; a dictionary beyond the
   bitmap's size (a short value takes 24 bits for one false alarm in 500, a long one as much for its
   head, each block and its end) only lets more survivors through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cloakstone.functions.text import MIN_COMPARED_LENGTH, fingerprint, strip
from cloakstone.operators.classify import cells
from cloakstone.sources.session import keep

GRAM = MIN_COMPARED_LENGTH
HEAD = 64  # characters of a value that the filter looks at
FILTER_BITS = 1 << 28  # of the bitmap: 32 MiB, whatever the dictionary
SLOT_BITS = 20  # of the table of lengths: 8 MiB
PROBES = (0, 1, 2)
TOP = 4096  # characters of the largest block of a long value
SIZES = np.array([0, *(TOP >> k for k in range(TOP.bit_length()))], np.uint64)  # 0 is the end of a value
BLOCK = 1 << 19  # characters hashed at once
GATED = 16  # suspects that are looked for in the JVM first
_BASE = 0x9E3779B97F4A7C15 | 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # filled in the Python worker


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if n not in _POWERS:
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


def _prefix_sums(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(_span(len(codes)))[0][: len(codes)], out=sums[1:])
    return sums


def _span(n: int) -> int:
    """Table sizes are powers of two so the cache is hit."""
    return max(1 << 10, 1 << (max(n, 1) - 1).bit_length())


def _hashes(sums: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mixed hash of ``text[p:p+length]`` for every p in ``at``, wherever in a text it stands."""
    h = (sums[at + length] - sums[at]) * _powers(_span(len(sums)))[1][at]
    salt = np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2) * np.asarray(length).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * salt
    return h ^ (h >> np.uint64(29))


def _slots(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    if probe == 2:
        return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(20)) & np.uint64(bits - 1)
    return (h >> np.uint64(32 * probe)) & np.uint64(bits - 1)


def _set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    words = bitmap[(slots >> np.uint64(6)).astype(np.int64)]
    return (words >> (slots & np.uint64(63))) & np.uint64(1) == np.uint64(1)


def _state(before: bytes, block: str) -> bytes:
    """Fingerprint of a block and, by its key, of all blocks before it."""
    return blake2b(block.encode("utf-8", "surrogatepass"), digest_size=16, key=before).digest()


def _links(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of "a block of so many characters follows this fingerprint"."""
    h = (states ^ (sizes + np.uint64(1)) * np.uint64(_BASE)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _word(state: bytes) -> int:
    return int.from_bytes(state[:8], "little")


def _chain(value: str) -> list[tuple[int, int]]:
    """The links of a long value: (fingerprint so far, size of the next block), the last size 0."""
    state, at, links = _state(b"", value[:HEAD]), HEAD, []
    while at < len(value):
        size = min(TOP, 1 << ((len(value) - at).bit_length() - 1))
        links.append((_word(state), size))
        state, at = _state(state, value[at : at + size]), at + size
    return [*links, (_word(state), 0)]


def _ends(text: str, at: int, longest: int, bits: int, bitmap: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(end, fingerprint) of the long values that may begin at a position, shortest first or not.

    Sizes only fall once they are below ``TOP``, so a length is reached in one way.
    """
    ways = [(at + HEAD, _state(b"", text[at : at + HEAD]), 2 * TOP)]
    until = min(len(text), at + longest)
    while ways:
        end, state, last = ways.pop()
        sizes, links = SIZES, _links(np.full(len(SIZES), _word(state), np.uint64), SIZES)
        for probe in PROBES:
            known = _set(bitmap, _slots(links, bits, probe))
            sizes, links = sizes[known], links[known]
        for size in sizes.tolist():
            if not size:
                yield end, state
            elif end + size <= until and (size < last or size == TOP == last):
                ways.append((end + size, _state(state, text[end : end + size]), size))


def long_key(value: Column) -> Column:
    """What a long value is joined by; longer than any value that is joined as it stands."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


@dataclass(frozen=True)
class ValueFilter:
    """A dictionary as a bitmap of heads and links, and a table of the lengths that begin with a gram."""

    bits: int
    longest: int
    bitmap: Broadcast


def _length_bit(sizes: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (sizes - 1).astype(np.uint64)


def _filter_words(bits: int):
    """Bits to set as (64-bit word number, mask): the bitmap, then the table of lengths.

    Heads shorter than a gram are marked in the table's last slot.
    """
    table = bits // 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            heads = [v[:HEAD] for v in batch["value"].tolist()]
            sizes = np.array([len(v) for v in heads])
            starts = np.cumsum(sizes) - sizes
            sums = _prefix_sums("".join(heads))
            whole = _hashes(sums, starts, sizes)
            chains = [link for v in batch["value"].tolist() if len(v) >= HEAD for link in _chain(v)]
            if chains:
                states, follow = (np.array(side, np.uint64) for side in zip(*chains, strict=True))
                whole = np.concatenate([whole, _links(states, follow)])
            slots = np.unique(np.concatenate([_slots(whole, bits, probe) for probe in PROBES]))
            first = np.full(len(heads), 1 << SLOT_BITS)
            long = sizes >= GRAM
            first[long] = _slots(_hashes(sums, starts[long], GRAM), 1 << SLOT_BITS, 0)
            words = np.concatenate([(slots >> np.uint64(6)).astype(np.int64), table + first])
            masks = np.concatenate([np.uint64(1) << (slots & np.uint64(63)), _length_bit(sizes)])
            order = np.argsort(words, kind="stable")
            words, begin = np.unique(words[order], return_index=True)
            yield pd.DataFrame({"word": words, "mask": np.bitwise_or.reduceat(masks[order], begin).view(np.int64)})

    return run


def build_filter(dictionary: DataFrame, bits: int = FILTER_BITS, shortest: int = GRAM) -> ValueFilter:
    """The filter of a ``value`` dictionary; duplicates do no harm, so it need not be distinct."""
    bits = max(1 << 10, 1 << (bits.bit_length() - 1))  # a power of two
    dictionary = dictionary.where(F.length("value") >= shortest).select("value")
    longest = dictionary.agg(F.coalesce(F.max(F.length("value")), F.lit(0))).first()[0]
    rows = (
        dictionary.mapInPandas(_filter_words(bits), "word bigint, mask bigint")
        .groupBy("word").agg(F.bit_or("mask").alias("mask"))
        .toArrow()  # at most bits / 64 + 2**SLOT_BITS + 1 rows of two longs
    )
    bitmap = np.zeros(bits // 64 + (1 << SLOT_BITS) + 1, np.uint64)
    bitmap[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return ValueFilter(bits, longest, dictionary.sparkSession.sparkContext.broadcast(bitmap))


def _survivors(joined: str, ends: np.ndarray, bits: int, bitmap: np.ndarray):
    """(position, length) of substrings that may be heads; ``ends`` bounds each position's piece."""
    sums = _prefix_sums(joined)
    every = np.arange(len(joined), dtype=np.int64)
    at = every[: max(len(joined) - GRAM + 1, 0)]
    table = bitmap[bits // 64 :]
    wanted = table[_slots(_hashes(sums, at, GRAM), 1 << SLOT_BITS, 0).astype(np.int64)]
    at, wanted = at[wanted != 0], wanted[wanted != 0]
    tests = [(length, every) for length in range(1, GRAM) if table[-1] >> np.uint64(length - 1) & np.uint64(1)]
    here = int(np.bitwise_or.reduce(wanted)) if len(wanted) else 0
    for length in range(GRAM, HEAD + 1):
        if here >> (length - 1) & 1:
            tests.append((length, at[wanted & np.uint64(1 << (length - 1)) != 0]))
    for length, fits in tests:
        fits = fits[fits + length <= ends[fits]]
        whole = _hashes(sums, fits, length)
        for probe in PROBES:
            passed = _set(bitmap, _slots(whole, bits, probe))
            fits, whole = fits[passed], whole[passed]
        for p in fits.tolist():
            yield p, length


def scanner(filtered: ValueFilter, id_name: str):
    """The kernel that finds survivors of the filter in batches of (id, text)."""
    bits, longest, broadcast = filtered.bits, filtered.longest, filtered.bitmap
    overlap = HEAD - 1

    def pieces(texts: list[str]):
        """Texts packed into blocks; one longer than a block is cut into overlapping pieces."""
        pack, size = [], 0
        for row, text in enumerate(texts):
            step = max(BLOCK - overlap, BLOCK // 2)
            for start in range(0, max(len(text) - overlap, 1), step):
                piece = text[start : start + step + overlap]
                if pack and size + len(piece) > BLOCK:
                    yield pack
                    pack, size = [], 0
                pack.append((row, start, piece))
                size += len(piece)
        if pack:
            yield pack

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            counts: dict[tuple[int, str], list] = {}
            for pack in pieces(texts):
                joined = "".join(piece for _, _, piece in pack)
                sizes = np.array([len(piece) for _, _, piece in pack])
                starts = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(pack)), sizes)
                ends = np.append((starts + sizes)[owner], 0)
                for p, length in _survivors(joined, ends, bits, broadcast.value):
                    row, offset, _ = pack[owner[p]]
                    here = offset + p - int(starts[owner[p]])
                    if length < HEAD:
                        found = [(here + length, joined[p : p + length])]
                    else:
                        found = _ends(texts[row], here, longest, bits, broadcast.value)
                    for end, known in found:
                        # [end of the last one counted, how many, key]: occurrences do not overlap
                        seen = counts.setdefault((row, known), [0, 0, known])
                        if length == HEAD and not seen[1]:
                            digest = sha256(texts[row][here:end].encode("utf-8", "surrogatepass")).hexdigest()
                            seen[2] = f"sha256:{digest}"
                        if here >= seen[0]:
                            seen[0], seen[1] = end, seen[1] + 1
            if not counts:
                continue
            ids = batch[id_name].tolist()
            yield pd.DataFrame(
                {
                    id_name: pd.Series([ids[row] for row, _ in counts], dtype=batch[id_name].dtype),
                    "value": [key for _, _, key in counts.values()],
                    "occurrences": [n for _, n, _ in counts.values()],
                }
            )

    return run


def candidates(texts: DataFrame, filtered: ValueFilter, id_column: str) -> DataFrame:
    """Superset of the values that occur: substrings passing the filter, with their count per text.

    A long one is given by its digest (:func:`long_key`).
    """
    schema = StructType(
        [
            texts.schema[id_column],
            StructField("value", StringType()),
            StructField("occurrences", LongType()),
        ]
    )
    # No filter on the text here: pushed below, it would compute a derived text twice.
    return texts.select(id_column, "text").mapInPandas(scanner(filtered, id_column), schema)


def _as_texts(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Undecodable bytes are replaced, so no text can stop a scan."""
    return texts.select(id_column, F.coalesce(F.make_valid_utf8(text_column), F.lit("")).alias("text"))


def containment_pairs(
    texts: DataFrame, id_column: str, text_column: str, dictionary: DataFrame,
    bits: int = FILTER_BITS, salts: int = 16, shortest: int = GRAM,
) -> DataFrame:
    """Every (text, value) pair with its non-overlapping occurrences.

    The survivors of the one scan are kept in the shared folder.  The dictionary, which may hold copies, is
    cut down to values that really occur and joined on (key, salt), so one value found in a third
    of all texts is spread.
    """
    texts = _as_texts(texts, id_column, text_column)
    values = dictionary.where(F.length("value") >= shortest).select("value")
    hits = keep(candidates(texts, build_filter(values, bits, shortest), id_column), "survivors")
    return settle(hits, id_column, values, salts)


def settle(hits: DataFrame, id_column: str, values: DataFrame, salts: int = 16) -> DataFrame:
    """The pairs among survivors of a scan; of ``values``, the dictionary, only what occurs is made distinct."""
    short = F.length("value") < HEAD
    keyed = values.withColumn("key", F.when(short, F.col("value")).otherwise(long_key(F.col("value"))))
    known = keyed.join(hits.select(F.col("value").alias("key")).distinct(), "key", "left_semi").distinct()
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = hits.withColumnRenamed("value", "key").withColumn(
        "salt", F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")
    )
    return salted.join(spread, ["key", "salt"]).select(id_column, "value", "occurrences")


def occurring_values(
    texts: DataFrame, id_column: str, text_column: str, dictionary: DataFrame,
    bits: int = FILTER_BITS, shortest: int = GRAM,
) -> DataFrame:
    """Dictionary values found anywhere, with total non-overlapping occurrences.

    Counts are combined before the shuffle, so a value found in a third of all texts
    costs one row per task.
    """
    pairs = containment_pairs(texts, id_column, text_column, dictionary, bits, shortest=shortest)
    return pairs.groupBy("value").agg(F.sum("occurrences").alias("occurrences"))


def compared_cells(table: DataFrame, columns: list[str], distinct: bool = False) -> DataFrame:
    """Cells of the named columns as ``(column, value)``; unknown columns are ignored.

    Values are compared stripped, but ``distinct`` goes by the text as written: ``" X "``
    and ``"X"`` are two values.
    """
    known = [c for c in columns if c in table.columns]
    if not known:
        return table.sparkSession.createDataFrame([], "column string, value string")
    read = cells(table, known).select("column", "value")
    read = (read.distinct() if distinct else read).select("column", strip(F.col("value")).alias("value"))
    return read.where(F.length("value") >= MIN_COMPARED_LENGTH)


def value_scan(
    texts: DataFrame, id_column: str, text_column: str, table: DataFrame, columns: list[str],
    bits: int = FILTER_BITS,
) -> DataFrame:
    """Per identifier column: values compared and how many of them occur in the texts.

    The texts are scanned once; the cells are derived and made distinct once and kept, for the filter, for the
    join that settles the scan's survivors and for the counts.
    """
    compared = keep(compared_cells(table, columns, distinct=True), "compared")
    spotted = containment_pairs(texts, id_column, text_column, compared.select("value"), bits)
    return found_per_column(compared, spotted)


def found_per_column(compared: DataFrame, spotted: DataFrame) -> DataFrame:
    """Values compared and found per column, given the distinct cells and the pairs of a scan."""
    return (
        compared
        .join(spotted.select("value").distinct().withColumn("hit", F.lit(True)), "value", "left")
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("values_compared"),
            F.count("hit").alias("distinct_values_found"),
        )
    )


class ScanIncomplete(RuntimeError):
    """The scan proved nothing and must not be read as clean."""


def scan_summary(scan: DataFrame, known_columns: list[str]) -> DataFrame:
    """One row: totals and the verdict.  A scan that compared nothing has no verdict but failure."""
    return scan.agg(
        F.lit(len(known_columns)).cast("bigint").alias("columns_checked"),
        F.coalesce(F.sum("values_compared"), F.lit(0)).alias("values_compared"),
        F.coalesce(F.sum("distinct_values_found"), F.lit(0)).alias("values_found"),
    ).withColumns(
        {
            "leaked": F.col("values_found") > 0,
            "complete": F.col("values_compared") > 0,
        }
    )


def assert_complete(summary: DataFrame) -> dict:
    """Fail closed: raise unless values were compared."""
    row = summary.first()
    if row is None or not row["complete"]:
        raise ScanIncomplete("no values were compared, so the scan establishes nothing")
    return row.asDict()


def adjudicate(
    suspects: DataFrame, corpus: DataFrame, id_column: str, text_column: str,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """How often each suspected string occurs in the data: fingerprint and count, never the string.

    Occurrences are counted per row of the corpus; ``suspects`` has a ``candidate`` column.
    Strings of any length are searched, below the comparison length too.  Against a handful of
    suspects (``GATED``) the JVM leaves out rows that hold none; the strings are a subquery's result, so no
    plan or log shows them.
    """
    # Used several times below and costly to derive, so it is written once.
    listed = keep(suspects.select(F.col("candidate").alias("value")).where("value <> ''").distinct(), "suspects")
    if listed.limit(GATED + 1).count() <= GATED:
        few = listed.agg(F.collect_list("value")).scalar()
        line = F.make_valid_utf8(text_column)
        held = [F.coalesce(F.contains(line, F.get(few, F.lit(i))), F.lit(False)) for i in range(GATED)]
        corpus = corpus.where(functools.reduce(Column.__or__, held))
    totals = occurring_values(corpus, id_column, text_column, listed, bits, shortest=1)
    return listed.join(totals, "value", "left").select(
        fingerprint(F.col("value")).alias("fingerprint"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        (F.coalesce("occurrences", F.lit(0)) > 0).alias("leaked"),
    )
