"""Near-duplicate documents: one-permutation MinHash, banded buckets, star candidates, exact links.

A document's set holds its distinct shingles of ``width`` consecutive words (A-Z lower-cased).  One hash
of each shingle gives both its bin and its value; the least value of a bin is the signature entry,
and an empty bin borrows from the first filled one of a random order of its own (optimal
densification).  Bands of the signature are bucket keys.  Equal sets are one class, so copies
never meet in pairs.  In each bucket every member is tied to the smallest id, a star: the
candidate edges are fewer than the rows.  Connected stars form a cluster; every pair that any
bucket could name lies inside one.

Links are confirmed on full sets: 100 * intersection >= ``percent`` * union.  A cluster is cut into blocks of
bounded size, and each pair of blocks is compared in one task, which returns only the links that
join two of its components.  So no link between different texts is lost to the star shape, and no
pairs are emitted however large a cluster is.  Connected components of the links run distributed
(large star, small star).

Cases: a text without words, empty or null, has an empty set and is linked with nothing.  With fewer
than ``width`` words the whole sequence is the one shingle.  Documents are told apart by doc_id: rows with one id
share a component.  A row whose id is null stands alone and is kept, its component null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakstone.llm import kernels as K
from cloakstone.sources.session import discard, keep

BINS, ROWS = 128, 4
PROBE = np.random.default_rng(20240607).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
# A cluster is cut into blocks of at most so many shingles and documents; from SPREAD documents on, into
# up to 12 blocks (78 pairs of blocks), so that one cluster keeps many tasks busy.
BLOCK_SHINGLES, BLOCK_DOCS, SPREAD, SPREAD_BLOCKS = 500_000, 2_000, 128, 12


def shingle_hashes(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    begin, end = K.words(data, at)
    hashes = K.span_hashes(K.LOWER[data], begin, end)
    bounds = np.searchsorted(begin, at)
    n = len(hashes) - width + 1
    rolled = np.zeros(max(n, 0), K.U64)
    for j in range(width):
        rolled = rolled * K.U64(K.BASE) + hashes[j : j + max(n, 0)]
    rolled = K.mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], K.U64)
            for word in hashes[a:b]:
                whole = K.mix(whole * K.U64(K.BASE) + word)
            out.append(whole)
        else:
            out.append(np.zeros(0, K.U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` values per non-empty set, densified."""
    values = np.zeros((len(sets), BINS), K.U64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> K.U64(57)).astype(np.int64)
        first = np.r_[True, bins[1:] != bins[:-1]]
        values[i, bins[first]] = s[first]
        filled[i, bins[first]] = True
    donor = np.broadcast_to(np.arange(BINS), filled.shape).copy()
    missing = ~filled
    for probe in PROBE.T:
        if not missing.any():
            break
        found = missing & filled[:, probe]
        donor[found] = np.broadcast_to(probe, filled.shape)[found]
        missing &= ~found
    return np.take_along_axis(values, donor, axis=1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=K.U64), bands.shape[:2])
    for j in range(ROWS):
        key = K.mix(key * K.U64(K.BASE) + bands[:, :, j])
    return key.view(np.int64)


SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("print_a", T.LongType()),
        T.StructField("print_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _signer(width: int):
    @F.arrow_udf(SIGNED)
    def signed(column: pa.Array) -> pa.Array:
        data, at = K.buffers(column)
        size, prints, keys = [], [], []
        for piece, offsets in K.slices(data, at):
            sets = shingle_hashes(piece, offsets, width)
            size += [len(s) for s in sets]
            prints += [(K.mix(s).sum(), K.mix(s ^ K.U64(K.BASE)).sum()) for s in sets]
            worded = [s for s in sets if len(s)]
            if worded:
                keys.append(band_keys(signatures(worded)))
        size = np.array(size, np.int64)
        prints = np.array(prints, K.U64).reshape(-1, 2).view(np.int64)
        none = size == 0
        flat = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
        offsets = np.r_[0, np.cumsum(np.where(none, 0, BINS // ROWS))].astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array(size),
                pa.array(prints[:, 0], mask=none),
                pa.array(prints[:, 1], mask=none),
                pa.ListArray.from_arrays(offsets, pa.array(flat)),
            ],
            names=["n_shingles", "print_a", "print_b", "bands"],
        )

    return signed


def _setter(width: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets_of(column: pa.Array) -> pa.Array:
        data, at = K.buffers(column)
        sets = [s for piece, offsets in K.slices(data, at) for s in shingle_hashes(piece, offsets, width)]
        offsets = np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)].astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, K.U64)
        return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))

    return sets_of


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, component (its smallest node)."""
    stars = keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, stars = stars, keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of the two sides, as few as join the same sets."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max() + 1, np.int64)
    out = []
    for i in np.flatnonzero(left).tolist():
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        close = right & (100 * common >= percent * (sizes + sizes[i] - common))
        for j in np.flatnonzero(close).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def confirm(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within clusters; ``members`` has node, cluster, n_blocks, block, shingles."""
    lanes = members.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    ).select(
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node",
        "shingles",
    )
    key = ["cluster", "low", "high"]
    kind = members.schema["node"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by lane; a lane is compared when the next one begins."""
        lane, group = None, []

        def links() -> pa.RecordBatch:
            sets = [g[2] for g in group]
            block = np.array([g[1] for g in group])
            low, high = lane[1], lane[2]
            pairs = linked(sets, block == low, block == high, percent) if len(sets) > 1 else []
            nodes = [g[0] for g in group]
            return pa.RecordBatch.from_pydict({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("a", batch.schema.field("node").type), ("b", batch.schema.field("node").type)])
            lanes_here = list(zip(*[batch[k].to_pylist() for k in key], strict=True))
            shingles = batch["shingles"]
            flat = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ends = shingles.offsets.to_numpy()
            for i, (here, block, node) in enumerate(
                zip(lanes_here, batch["block"].to_pylist(), batch["node"].to_pylist(), strict=True)
            ):
                if here != lane:
                    if group:
                        yield links()
                    lane, group = here, []
                group.append((node, block, flat[ends[i] : ends[i + 1]].copy()))
        if group:
            yield links()

    sorted_lanes = lanes.repartition(*key).sortWithinPartitions(*key)
    return sorted_lanes.mapInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    signed = docs.select("doc_id", _signer(width)("text").alias("s")).select("doc_id", "s.*")
    signed = keep(signed, "signed")
    worded = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = keep(
        worded.groupBy("print_a", "print_b", "n_shingles").agg(
            F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")
        ),
        "classes",
    )
    banded = classes.select("node", F.explode("bands").alias("key"))
    centres = banded.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("far")).filter("centre < far")
    stars = banded.join(centres.select("key", "centre"), "key").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    clusters = components(stars.distinct()).withColumnRenamed("component", "cluster")
    sized = clusters.join(classes.select("node", "n_shingles"), "node")
    cut = sized.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS),
            F.least(F.lit(SPREAD_BLOCKS), F.ceil(F.count(F.lit(1)) / SPREAD)),
        ).cast("int").alias("n_blocks")
    )
    members = (
        docs.select("doc_id", "text")
        .join(clusters.join(cut, "cluster"), F.col("doc_id") == F.col("node"))
        .select("node", "cluster", "n_blocks", _setter(width)("text").alias("shingles"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        .filter(F.size("shingles") > 0)
    )
    found = components(keep(confirm(members, percent), "links"))
    reached = (
        classes.select("print_a", "print_b", F.col("n_shingles").alias("n"), "node")
        .join(found, "node", "left")
        .select("print_a", "print_b", "n", F.coalesce("component", "node").alias("component"))
    )
    return _judged(signed, reached, found)


def _judged(signed: DataFrame, reached: DataFrame, found: DataFrame) -> DataFrame:
    joined = signed.join(
        reached,
        (signed["print_a"] == reached["print_a"])
        & (signed["print_b"] == reached["print_b"])
        & (signed["n_shingles"] == reached["n"])
        & signed["doc_id"].isNotNull(),
        "left",
    )
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **matching) -> DataFrame:
    """``docs`` with one document of each component; rows without an id stay."""
    judged = near_duplicates(docs.select("doc_id", "text"), **matching)
    gone = keep(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
