"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes of a text places a cut wherever some of its bits are small, so
cuts depend on the last 24 bytes only: an insertion moves the cuts near it and no others.  Each
chunk has a 64-bit digest.  A digest found in more than one document marks its chunks as
repeated; consecutive repeated chunks of a document form an island, and islands of at least
``min_words`` words are reported.  An island is one span for each piece of so many words with one
first holder.  Cuts stand between characters.  The repeated passage reaches up to a chunk further on both
sides, so the default of 25 words finds passages of over 50 words and leaves shared lines of a
sentence alone.

Cases: a null or empty text has no chunk.  Documents are told apart by doc_id: a row whose id is
null has no chunks, and rows with one id are one document, so repeated rows do not repeat each other.
Rows of one id with different texts keep spans of their own, told apart by a 64-bit hash of the text.
``first_doc`` is the smallest id holding the span's chunks; only stretches under ``min_words`` words of a span
can have another first holder, and where all are so short it is the smallest of them.  A text with more
bytes than a slice is worked off alone.  An empty table has no span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cloakstone.llm import kernels as K
from cloakstone.sources.session import keep

GEAR = K.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
REACH, SMALLEST, LARGEST = 24, 16, 256


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2h + gear[byte] after each byte, its last 32 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def cuts(data: np.ndarray, average: int) -> np.ndarray:
    """Positions after which a cut may be: bits 12 to 23 depend on the last 24 bytes."""
    bits = (gear_hashes(data) >> np.uint32(REACH - 12)) & np.uint32(0xFFF)
    found = np.flatnonzero(bits < 4096 // average) + 1
    return found[~inner(data, found)]


def inner(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where a position stands inside a UTF-8 character."""
    return (at < len(data)) & (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80)


def chunks_of(data: np.ndarray, at: np.ndarray, average: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each chunk; a text's last chunk ends with it."""
    ends, of = [], []
    for i in range(len(at) - 1):
        text = data[at[i] : at[i + 1]]
        here, size = 0, len(text)
        for cut in [*cuts(text, average).tolist(), size] if size else []:
            while cut - here > LARGEST:
                here += LARGEST
                here -= next((k for k in range(4) if text[here - k] & 0xC0 != 0x80), 0)
                ends.append(at[i] + here)
                of.append(i)
            if cut - here >= SMALLEST or cut == size > here:
                here = cut
                ends.append(at[i] + here)
                of.append(i)
    ends, of = np.array(ends, np.int64), np.array(of, np.int64)
    first = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    starts = np.where(first, at[of], np.r_[0, ends[:-1]]) if len(of) else ends
    return starts, ends, of


CHUNK = pa.struct([("start", pa.int32()), ("bytes", pa.int16()), ("words", pa.int16()), ("digest", pa.int64())])
CHUNK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("bytes", T.ShortType()),
            T.StructField("words", T.ShortType()),
            T.StructField("digest", T.LongType()),
        ]
    )
)


def _chunker(average: int):
    @F.arrow_udf(CHUNK_TYPE)
    def chunked(column: pa.Array) -> pa.Array:
        data, at = K.buffers(column)
        counts, parts = [np.zeros(1, np.int32)], []
        for piece, offsets in K.slices(data, at):
            starts, ends, of = chunks_of(piece, offsets, average)
            begin, _ = K.words(piece, offsets)
            n_words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
            digests = K.span_hashes(piece, starts, ends).view(np.int64)
            counts.append(np.bincount(of, minlength=len(offsets) - 1).astype(np.int32))
            parts.append((starts - offsets[of], ends - starts, n_words, digests))
        fields = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, int)] * 4
        arrays = [pa.array(x, f.type, safe=False) for x, f in zip(fields, CHUNK, strict=True)]
        values = pa.StructArray.from_arrays(arrays, fields=list(CHUNK))
        return pa.ListArray.from_arrays(np.cumsum(np.concatenate(counts), dtype=np.int32), values)

    return chunked


def chunk_rows(docs: DataFrame, average: int = 24) -> DataFrame:
    """doc_id, version (of the text), seq, start, bytes, words, digest of every chunk of every text."""
    own = docs.filter("doc_id IS NOT NULL").select("doc_id", version(F.col("text")).alias("version"), _chunker(average)("text").alias("chunks"))
    rows = own.select("doc_id", "version", F.posexplode("chunks").alias("seq", "chunk"))
    return rows.select("doc_id", "version", "seq", "chunk.*")


def version(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(text)


def _pieces(docs: DataFrame, average: int) -> DataFrame:
    """Repeated chunks in a row with one first holder: doc_id, version, island, piece, first_doc, their bytes, words and number."""
    rows = keep(chunk_rows(docs, average), "chunks")
    shared = (
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .filter("first_doc <> last_doc")
        .select("digest", "first_doc")
    )
    marked = rows.join(shared, "digest").select("doc_id", "version", "seq", "start", "bytes", "words", "first_doc").distinct()
    in_order = Window.partitionBy("doc_id", "version").orderBy("seq", "start")
    opens = F.coalesce(F.lag("first_doc").over(in_order) != F.col("first_doc"), F.lit(True))
    return (
        marked.withColumn("island", F.col("seq") - F.row_number().over(in_order))
        .withColumn("opens", opens.cast("int"))
        .withColumn("piece", F.sum("opens").over(in_order))
        .groupBy("doc_id", "version", "island", "piece", "first_doc")
        .agg(
            F.min("start").cast("long").alias("start_byte"),
            F.max(F.col("start") + F.col("bytes")).cast("long").alias("end_byte"),
            F.sum("words").alias("n_words"),
            F.count(F.lit(1)).alias("n_chunks"),
        )
    )


def repeated_spans(docs: DataFrame, average: int = 24, min_words: int = 25) -> DataFrame:
    """Repeated spans: doc_id, start_byte, end_byte, n_words, n_chunks, first_doc."""
    island = Window.partitionBy("doc_id", "version", "island")
    large = F.col("n_words") >= min_words
    # Every large piece is a span; small ones go to the large one before them, or else to the first.
    before = F.last(F.when(large, F.col("piece")), ignorenulls=True).over(island.orderBy("piece"))
    first = F.min(F.when(large, F.col("piece"))).over(island)
    return (
        _pieces(docs, average)
        .withColumn("total", F.sum("n_words").over(island))
        .withColumn("span", F.coalesce(before, first))
        .filter(F.col("total") >= min_words)
        .groupBy("doc_id", "version", "island", "span")
        .agg(
            F.min("start_byte").alias("start_byte"),
            F.max("end_byte").alias("end_byte"),
            F.coalesce(F.min(F.when(large, F.col("first_doc"))), F.min("first_doc")).alias("first_doc"),
            F.sum("n_words").alias("n_words"),
            F.sum("n_chunks").alias("n_chunks"),
        )
        .select("doc_id", "start_byte", "end_byte", "n_words", "n_chunks", "first_doc")
    )


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for value, cut in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if value is not None and cut:
            raw, parts, here = value.encode(), [], 0
            for span in sorted(cut, key=lambda s: s["start_byte"]):
                parts.append(raw[here : span["start_byte"]])
                here = max(here, span["end_byte"])
            value = b"".join([*parts, raw[here:]]).decode("utf-8", "ignore")
        out.append(value)
    return pa.array(out, pa.string())


def drop_repeats(docs: DataFrame, average: int = 24, min_words: int = 25) -> DataFrame:
    """``docs`` with repeated text cut out of every document but the first that holds it.

    Only chunks that another document holds first are cut, ``min_words`` words of them in a row at least.
    """
    own = (F.col("first_doc") == F.col("doc_id")).cast("int")
    in_order = Window.partitionBy("doc_id", "version", "island").orderBy("piece")
    spans = (
        _pieces(docs, average)
        .withColumn("run", F.sum(own).over(in_order))
        .filter("doc_id <> first_doc")
        .withColumn("total", F.sum("n_words").over(Window.partitionBy("doc_id", "version", "island", "run")))
        .filter(F.col("total") >= min_words)
    )
    listed = spans.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(
        F.collect_list(F.struct("start_byte", "end_byte")).alias("__spans")
    )
    mine = (docs["doc_id"] == listed["__id"]) & (version(docs["text"]) == listed["__version"])
    joined = docs.join(listed, mine, "left")
    return joined.select(*[_without(docs["text"], "__spans").alias(c) if c == "text" else docs[c] for c in docs.columns])
