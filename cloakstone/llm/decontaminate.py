"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in normal form: A-Z lower-cased, every run of ASCII characters that are
neither letters nor digits one space.  An item of n bytes may differ by k = n // ``chars_per_edit``
edits.  It is split into k + 1 pieces, so any occurrence within k edits holds one piece unchanged.
The first bytes of each piece are its anchor: ``ANCHOR`` of them, or the largest of ``SIZES`` that fits into
the shortest piece of a short item.  Every position of every whole document is
hashed over as many bytes, for each size the items have, and looked up twice in a bitmap of fixed size (``BITS``), which is all that
is broadcast, however large the benchmark is; what passes is joined with the anchors by hash.  Each
candidate is then verified on the text around the hit with Myers' bit-parallel edit distance.

Items of fewer than ``min_chars`` bytes in normal form are too short for edits: they are found
unchanged, as whole words, by the same scan (their one anchor begins with the blank before them).

Cases: null or empty texts and items match nothing.  An occurrence of an item of ``min_chars`` bytes or
more may begin or end inside a word of the document.  Repeated
items are reported for each id, repeated documents once per id.  Empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakstone.llm import kernels as K
from cloakstone.sources.session import keep

ANCHOR, BITS = 12, 27
SIZES = (ANCHOR, 10, 8, 6, 4, 3)  # of anchors, in bytes
LEAST = 6  # bytes of a piece; a shorter item is matched whole

_FORM = bytearray(range(256))
for _byte in range(128):
    _sign = chr(_byte)
    _FORM[_byte] = ord(_sign.lower()) if _sign.isalnum() else 32
FORM = bytes(_FORM)


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(FORM).split())


def pieces(item: bytes, chars_per_edit: int) -> list[int]:
    """Starts of the budget-plus-one pieces of an item, of even length."""
    count = len(item) // chars_per_edit + 1
    return [len(item) * j // count for j in range(count)]


def anchor_size(item: bytes, chars_per_edit: int) -> int:
    """The bytes of an item's anchors: no more than its shortest piece has."""
    shortest = len(item) // (len(item) // chars_per_edit + 1)
    return next(size for size in SIZES if size <= shortest)


def anchor_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of the ``size`` bytes that start at each position (the last ones wrap and match nothing)."""
    padded = np.concatenate([data, np.zeros(ANCHOR, np.uint8)]).astype(np.uint64)
    two = padded[:-1] | padded[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    n = len(data)
    if size < 6:
        return K.mix((four[:n] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size << 40))
    if size == 6:
        return K.mix((four[:n] | two[4 : 4 + n] << np.uint64(32)) + np.uint64(size))
    eight = (four[:-4] | four[4:] << np.uint64(32))[:n] * np.uint64(K.BASE)
    rest = {8: np.uint64(0), 10: two[8 : 8 + n], 12: four[8 : 8 + n]}[size]
    return K.mix(eight + rest + np.uint64((ANCHOR - size) << 40))


def distance(item: bytes, text: bytes, limit: int) -> tuple[int, int]:
    """Least edit distance between the item and any part of the text, and where that part ends.

    Myers' algorithm on one long integer per vertical delta; -1 if it is beyond the limit.
    """
    size = len(item)
    if not size:
        return -1, -1
    full, high = (1 << size) - 1, 1 << (size - 1)
    masks: dict[int, int] = {}
    for i, byte in enumerate(item):
        masks[byte] = masks.get(byte, 0) | 1 << i
    up, down, score, best, end = full, 0, size, size, 0
    for at, byte in enumerate(text):
        equal = masks.get(byte, 0)
        level = equal | down
        equal |= ((equal & up) + up) ^ up
        over = down | ~(equal | up) & full
        under = up & equal
        if over & high:
            score += 1
        elif under & high:
            score -= 1
        over, under = (over << 1) & full, (under << 1) & full
        up = under | ~(level | over) & full
        down = over & level
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= limit else (-1, -1)


ITEM = "item_id long, item binary, budget int, anchors array<struct<piece_at int, anchor long>>, anchor_bytes int"
WINDOW = "doc_id {id}, window_at long, window binary, hits array<struct<at int, anchor long>>"
PAIR = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _rows(names: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split()
    )


def normal_items(benchmark: DataFrame, chars_per_edit: int, min_chars: int) -> DataFrame:
    """Items with a word: item_id, item (normal form, a short one between blanks), budget, anchors of their pieces and the bytes of each."""
    if chars_per_edit <= ANCHOR:
        raise ValueError(f"pieces of {chars_per_edit} characters can be shorter than their anchor of {ANCHOR}")
    anchor = pa.list_(pa.struct([("piece_at", pa.int32()), ("anchor", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                item = normal((text or "").encode())
                if not item:
                    continue
                if len(item) < max(min_chars, LEAST):
                    item, budget = b" " + item + b" ", 0
                    starts, size = [0], next(size for size in SIZES if size <= len(item))
                else:
                    starts, size = pieces(item, chars_per_edit), anchor_size(item, chars_per_edit)
                    budget = len(item) // chars_per_edit
                codes = anchor_hashes(np.frombuffer(item, np.uint8), size).view(np.int64)
                found = [{"piece_at": at, "anchor": int(codes[at])} for at in starts]
                out.append((item_id, item, budget, found, size))
            kinds = [pa.int64(), pa.binary(), pa.int32(), anchor, pa.int32()]
            yield _rows("item_id item budget anchors anchor_bytes", kinds, out)

    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return keep(chosen.mapInArrow(cut, ITEM).distinct(), "items")


def slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the bitmap that a hash sets."""
    return codes >> np.uint64(64 - BITS), codes & np.uint64((1 << BITS) - 1)


def anchor_bitmap(spark: SparkSession, items: DataFrame) -> Broadcast:
    """The anchors as a bitmap of 2**BITS bits: 16 MiB, whatever the number of items."""
    both = F.array(F.shiftrightunsigned("anchors.anchor", 64 - BITS), F.col("anchors.anchor").bitwiseAND((1 << BITS) - 1))
    slot = F.col("slot")
    words = (
        items.select(F.explode("anchors").alias("anchors"))
        .select(F.explode(both).alias("slot"))
        .select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bitmap.view(np.uint8))


def anchor_windows(docs: DataFrame, bitmap: Broadcast, reach: int, sizes: list[int]) -> DataFrame:
    """Text around the positions that pass the bitmap, near ones in one window: doc_id, window_at, window, hits.

    ``sizes`` are the bytes of anchors that are looked up.
    """
    kind = docs.schema["doc_id"].dataType
    hit = pa.list_(pa.struct([("at", pa.int32()), ("anchor", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.binary(), hit]

    def passing(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        found = np.arange(len(codes))
        for slot in slots(codes):
            here = slot[found]
            found = found[(bits[here >> np.uint64(3)] >> (here & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            data, at = K.buffers(batch["text"])
            out: list[tuple] = []
            for i in range(len(at) - 1):
                text = b" " + normal(data[at[i] : at[i + 1]].tobytes()) + b" "
                found: list[tuple[int, int]] = []
                for size in sizes:
                    codes = anchor_hashes(np.frombuffer(text, np.uint8), size)[: max(0, len(text) - size + 1)]
                    here = passing(codes, bits)
                    found += zip(here.tolist(), codes[here].view(np.int64).tolist(), strict=True)
                found.sort()
                group: list[tuple[int, int]] = []
                for hit in [*found, None]:
                    if group and (hit is None or hit[0] - group[-1][0] > reach or hit[0] - group[0][0] > 2 * reach):
                        begin = max(0, group[0][0] - reach)
                        hits = [{"at": p - begin, "anchor": code} for p, code in group]
                        out.append((i, begin, text[begin : group[-1][0] + reach], hits))
                        group = []
                    if hit is not None:
                        group.append(hit)
            rows = _rows("doc_id window_at window hits", kinds, out)
            yield rows.set_column(0, "doc_id", batch["doc_id"].take(rows["doc_id"]))

    schema = WINDOW.format(id=kind.simpleString())
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(scan, schema)


@F.arrow_udf(PAIR)
def _verified(window: pa.Array, low: pa.Array, high: pa.Array, item: pa.Array, budget: pa.Array) -> pa.Array:
    out = []
    for text, a, b, pattern, limit in zip(
        window.to_pylist(), low.to_pylist(), high.to_pylist(), item.to_pylist(), budget.to_pylist(), strict=True
    ):
        begin = max(0, a - limit)
        found, end = distance(pattern, text[begin : b + len(pattern) + limit], limit)
        out.append({"distance": found, "end": begin + end})
    return pa.array(out, pa.struct([("distance", pa.int32()), ("end", pa.int32())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = 16, min_chars: int = 20) -> DataFrame:
    """Pairs of document and benchmark item found in it: doc_id, item_id, distance, item_bytes.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    items = normal_items(benchmark, chars_per_edit, min_chars)
    longest = items.agg(F.coalesce(F.max(F.length("item") + F.col("budget")), F.lit(0)).alias("n")).first()["n"]
    sizes = [r["anchor_bytes"] for r in items.select("anchor_bytes").distinct().collect()]
    windows = keep(anchor_windows(docs, anchor_bitmap(docs.sparkSession, items), longest + ANCHOR, sizes), "windows")
    anchors = items.select("item_id", F.length("item").alias("size"), F.explode("anchors").alias("piece"))
    # Where the item would begin in the window; near starts of one item are verified together.
    lanes = (
        windows.select("doc_id", "window_at", F.explode("hits").alias("hit"))
        .join(anchors, F.col("hit.anchor") == F.col("piece.anchor"))
        .withColumn("start", F.col("hit.at") - F.col("piece.piece_at"))
        .groupBy("doc_id", "window_at", "item_id", F.floor(F.col("start") / (F.col("size") + 1)).alias("lane"))
        .agg(F.min("start").alias("low"), F.max("start").alias("high"))
    )
    texts = windows.select("doc_id", "window_at", "window").dropDuplicates(["doc_id", "window_at", "window"])
    checked = (
        lanes.join(texts, ["doc_id", "window_at"])
        .join(items.select("item_id", "item", "budget"), "item_id")
        .select(
            "doc_id", "item_id", _verified("window", "low", "high", "item", "budget").alias("found"),
            F.length(F.trim(F.col("item").cast("string")).cast("binary")).alias("item_bytes"),
        )
    )
    return (
        checked.filter("found.distance >= 0")
        .groupBy("doc_id", "item_id")
        .agg(F.min("found.distance").alias("distance"), F.max("item_bytes").alias("item_bytes"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **matching) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found; rows without an id stay."""
    found = keep(contaminated(docs, benchmark, **matching).select(F.col("doc_id").alias("__id")).distinct(), "found")
    return docs.join(found, docs["doc_id"] == found["__id"], "left_anti")
