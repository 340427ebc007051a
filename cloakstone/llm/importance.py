"""Importance resampling towards a target corpus, ranked by a parallel sort with regular sampling.

Features are the runs of one to ``longest`` consecutive words of a text, hashed into ``buckets``
(CRC-32 of their UTF-8 bytes).  A bucket's gain is its log ratio target to source, smoothed by one,
in thousandths; a document's weight is the floored mean of its features' gains.  Gumbel noise drawn
from the id turns the best scores into a draw without replacement.

Both passes over the texts are array work inside tasks: the first reduces each task to one count
per bucket, the second looks gains up in an array of ``buckets`` numbers, the only thing sent to tasks.

The order is found as in sorting by regular sampling.  Each task sorts its rows and hands on rows at
regular distances; these samples are thinned the same way until ``samples`` at most are left, and
regular ones of them become the splitters.  Counts before each segment say where it starts in the
global order.  Segments that begin behind the last drawn rank are not exchanged at all; the others
are dealt one segment a group and merged there, so a rank is the segment's start plus a place inside.
Equal keys are told apart by a number of the row, so no segment grows with repeated rows.

Cases: a null text has no words, weight 0 and is never drawn unless ``least_words`` is 0.  A null id
draws its noise from the text ``null`` and sorts after all other ids.  Rows with one id draw the same
noise; ties go to the smaller id, then to fewer features.  Repeated rows are ranked one by one.  An
empty table gives an empty result, an empty target the gains of zero counts.  Other columns than id
and text are ignored unless carried, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakstone.llm import kernels as K
from cloakstone.sources.session import keep

WORD_BYTES = K.table_of(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
SHORT = 64  # bytes up to which spans are hashed column by column
ORDER = ["__score", "__nameless", "__id", "__features", "__row"]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes; all spans advance together, byte by byte."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    short = np.flatnonzero(length <= SHORT)
    order = short[np.argsort(-length[short], kind="stable")]
    at, size = starts[order], -length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(-int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(size, -j))  # spans longer than j
        head = crc[:n]
        crc[:n] = CRC[(head ^ data[at[:n] + j]) & 0xFF] ^ (head >> 8)
    out[order] = ~crc
    return out


def features(data: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and text of every feature, and the number of words of each text."""
    data = K.LOWER[data]
    begin, end = K.runs(WORD_BYTES[data], at)
    of = K.owners(at, begin)
    hashes, texts = [crc_of_spans(data, begin, end)], [of]
    if longest > 1 and len(begin):  # words of a text joined by one space each
        length = end - begin + 1
        place = np.cumsum(length) - length
        joined = data[np.minimum(np.repeat(begin - place, length) + np.arange(length.sum()), len(data) - 1)]
        joined[place + length - 1] = 32
        for n in range(2, longest + 1):
            first = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
            last = first + n - 1
            hashes.append(crc_of_spans(joined, place[first], place[last] + length[last] - 1))
            texts.append(of[first])
    return np.concatenate(hashes), np.concatenate(texts), np.bincount(of, minlength=len(at) - 1)


def bucket_counts(texts: DataFrame, column: str, longest: int, buckets: int) -> DataFrame:
    """Features per bucket over whole texts; each task hands on one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, at in K.slices(*K.buffers(batch.column(0))):
                hashes, _, _ = features(data, at, longest)
                total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col(column).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket, in thousandths; the two count tables have ``buckets`` rows at most."""
    counts = []
    for table in (source, target):
        row = np.zeros(buckets, np.int64)
        for bucket, n in table.collect():
            row[bucket] = n
        counts.append(row.tolist())
    all_source, all_target = (sum(row) + buckets for row in counts)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(*counts, strict=True)],
        np.int64,
    )


def weigh(text: Column, gain: np.ndarray, longest: int) -> Column:
    """Words, features and weight of a column of texts, as one struct."""
    buckets = np.uint32(len(gain))

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weighed(column: pa.Array) -> pa.Array:
        words, sizes, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data, at in K.slices(*K.buffers(column)):
            hashes, of, n_words = features(data, at, longest)
            size = np.bincount(of, minlength=len(at) - 1)
            total = np.zeros(len(at) - 1, np.int64)
            np.add.at(total, of, gain[hashes % buckets])
            words.append(n_words)
            sizes.append(size)
            weights.append(total // np.maximum(size, 1))
        arrays = [pa.array(np.concatenate(part), pa.int64()) for part in (words, sizes, weights)]
        return pa.StructArray.from_arrays(arrays, names=["n_words", "n_features", "weight"])

    return weighed(text)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")


def _thinner(keep_at_most: int):
    """Rows at regular distances of a sorted run, as many as asked for to twice that; each carries the rows it stands for.

    The distance doubles whenever the kept rows grow too many, so a run of any length needs no second reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, seen, kept = 1, 0, None
        for batch in batches:
            stands_for = batch.column("__stands_for").to_numpy()
            upto = seen + np.cumsum(stands_for)
            seen = int(upto[-1]) if len(upto) else seen
            rows = pa.Table.from_batches([batch]).append_column("__upto", pa.array(upto, pa.int64()))
            kept = rows if kept is None else pa.concat_tables([kept, rows])

            def regular(step: int) -> np.ndarray:
                end = kept["__upto"].to_numpy()
                return end // step != (end - kept["__stands_for"].to_numpy()) // step

            kept = kept.filter(pa.array(regular(step)))
            while kept.num_rows > 2 * keep_at_most:
                step *= 2
                kept = kept.filter(pa.array(regular(step)))
        if kept is not None:
            weight = np.diff(kept["__upto"].to_numpy(), prepend=0)
            at = kept.column_names.index("__stands_for")
            kept = kept.set_column(at, "__stands_for", pa.array(weight, pa.int64())).drop_columns(["__upto"])
            yield from kept.combine_chunks().to_batches()

    return run


def splitters(rows: DataFrame, order: list[str], segments: int, samples: int = 100_000) -> list[tuple]:
    """At most ``segments - 1`` rows that cut ``rows`` into segments of about equal size.

    ``samples`` bounds what the driver sees, whatever the number of runs.
    """
    thin = _thinner(2 * segments)
    taken = rows.select(*order, F.lit(1).cast("long").alias("__stands_for"))
    parts = 0
    while True:
        sampled = taken.sortWithinPartitions(*order).mapInArrow(thin, taken.schema)
        taken = keep(sampled, "samples")
        if taken.count() <= max(samples, 4 * segments):
            break
        runs = taken.rdd.getNumPartitions()
        parts = runs if not parts else min(runs, parts)
        parts = max(1, parts // 16)
        taken = taken.coalesce(parts)
    sample = sorted(tuple(r) for r in taken.collect())
    upto = np.cumsum([r[-1] for r in sample])
    if not len(upto):
        return []
    places = np.searchsorted(upto, upto[-1] * np.arange(1, segments) / segments)
    return sorted({sample[i][:-1] for i in places})


def segment_of(order: list[Column], cuts: list[tuple]) -> Column:
    """Number of the segment of a row: how many splitters are not above it."""
    first = np.array([cut[0] for cut in cuts], np.int64)

    @F.arrow_udf("int")
    def located(*columns: pa.Array) -> pa.Array:
        lead = columns[0].to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(first, lead, "left"), np.searchsorted(first, lead, "right")
        tied = np.flatnonzero(low < high)  # rows that share their score with a splitter: compared in full
        if len(tied):
            keys = zip(*[c.take(pa.array(tied)).to_pylist() for c in columns], strict=True)
            low[tied] = [bisect_right(cuts, key) for key in keys]
        return pa.array(low, pa.int32())

    return located(*order)


def ranked(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20,
    seed: int = 2024, carry: tuple[str, ...] = (), segments: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every document's id, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn.  Columns in ``carry`` travel along;
    ``segments`` is the number of sorted segments, the session's shuffle partitions by default.
    """
    spark = docs.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets), buckets)
    held = [F.col(c).alias(f"__carried_{i}") for i, c in enumerate(carry)]
    weighed = docs.select(F.col(key).alias("__id"), *held, weigh(F.col(text), gain, longest).alias("__w"))
    scored = keep(
        weighed.select(
            "__id", *[f"__carried_{i}" for i in range(len(carry))],
            (F.col("__w.n_words") >= least_words).alias("__eligible"),
            F.col("__w.n_features").alias("__features"), F.col("__w.weight").alias("__weight"),
            (-(F.col("__w.weight") + noise(F.col("__id"), seed))).alias("__score"),  # ascending order, best first
            F.monotonically_increasing_id().alias("__row"), F.col("__id").isNull().alias("__nameless"),
        ),
        "scored",
    )
    eligible = scored.where("__eligible")
    drawn = percent * eligible.count() // 100
    # A null id compares equal to any other null id: the row number decides.
    kind = scored.schema["__id"].dataType
    blank = F.lit("" if kind.typeName() == "string" else 0).cast(kind)
    order = [F.coalesce("__id", blank) if c == "__id" else F.col(c) for c in ORDER]
    cuts = splitters(eligible.select(*[c.alias(n) for c, n in zip(order, ORDER, strict=True)]), ORDER, segments)
    placed = scored.withColumn("__segment", F.when(F.col("__eligible"), segment_of(order, cuts)) if cuts else F.lit(0))
    sizes = dict(placed.where("__eligible").groupBy("__segment").count().collect())  # one row a segment
    starts, before = [], 0
    for number in range(len(cuts) + 1):
        starts.append(before)
        before += sizes.get(number, 0)
    open_segments = sum(start < drawn for start in starts)
    begins = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("__segment"))
    inside = F.row_number().over(Window.partitionBy("__segment").orderBy(*order))
    is_open = F.col("__eligible") & (F.col("__segment") < open_segments)
    rank = begins + inside
    merged = placed.where(is_open).withColumn("__rank", F.when(rank <= drawn, rank))
    rest = placed.where(~is_open).withColumn("__rank", F.lit(None).cast("long"))
    return merged.unionByName(rest).select(
        F.col("__id").alias(key), *[F.col(f"__carried_{i}").alias(c) for i, c in enumerate(carry)],
        F.col("__features").alias("n_features"), F.col("__weight").alias("weight"),
        (-F.col("__score")).alias("score"), F.col("__rank").alias("rank"),
    )


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, all their columns, in no order."""
    own = options.get("key", "doc_id")
    others = tuple(c for c in docs.columns if c != own)
    renamed = docs.select(own, *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    text = f"c{others.index(options.pop('text', 'text'))}"
    chosen = ranked(renamed, target.select(F.col("text").alias(text)), carry=tuple(renamed.columns[1:]), text=text, **options)
    names = {f"c{i}": c for i, c in enumerate(others)} | {own: own}
    back = {c: n for n, c in names.items()}
    return chosen.where("rank IS NOT NULL").select(*[F.col(back[c]).alias(c) for c in docs.columns])
