"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, vectorised, and settled in the shared folder as
one small float array per document.  The trees are fitted in numpy on labelled rows and flattened
into arrays (feature, threshold, left, value); scoring walks all documents of a batch through each
level of a tree at once.

``sample`` bounds the labelled rows the fit sees (a parameter): if there are more, each labelled row
stays with the same probability, drawn from the hash of its id.  Everything else covers all rows.

Cases: a null or empty text has statistics like any other (all zero) and gets a score.  Labels
with a null quality are left out; a document labelled several times has its lowest label.
Repeated rows score alike.  A null id is never held out and never trained on.  Without any label, or
with labels of one kind, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakstone.llm import kernels as K
from cloakstone.llm.common import uniform
from cloakstone.llm.quality_rules import CAPITAL, FULL_STOP, HIGH, SMALL, SYMBOL
from cloakstone.sources.session import discard, keep

DIGIT = K.table_of(b"0123456789")
STATISTICS = (
    "words", "chars_per_word", "longest_word", "symbols", "pipes", "hashes", "shouts", "stops", "digits",
    "capitals", "letters", "non_ascii", "distinct_words", "same_as_last", "repeat_3", "repeat_8", "top_word",
    "lines", "words_per_line", "again_lines", "closed_lines", "short_lines", "long_words", "marked_words",
)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    n = len(at) - 1
    begin, end = K.words(data, at)
    of = K.owners(at, begin)
    hashes = K.span_hashes(data, begin, end)
    n_words = np.bincount(of, minlength=n)
    some = np.maximum(n_words, 1)
    size = np.maximum(np.diff(at), 1)
    length = end - begin

    def per_word(flags):
        return np.bincount(of[flags], minlength=n) / some

    def share(flags):
        return K.per_text(flags, at) / size

    keys = K.keyed(of, hashes)
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    distinct = np.bincount(of[first], minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, of[first], counts)
    same = np.zeros(len(begin), bool)
    same[1:] = keys[1:] == keys[:-1]
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    starts, ends, text = K.lines(data, at)
    line_words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    n_lines = np.maximum(np.bincount(text, minlength=n), 1)
    again = K.seen_before(K.keyed(text, K.span_hashes(data, starts, ends)))
    last = np.searchsorted(begin, ends) - 1
    closed = (line_words > 0) & FULL_STOP[data[np.maximum(end[last] - 1, 0)]] if len(begin) else np.zeros(len(starts), bool)
    marked = K.between(SYMBOL[data], begin, end) > 0

    def per_line(flags):
        return np.bincount(text[flags], minlength=n) / n_lines

    columns = (
        np.log1p(n_words), np.bincount(of, weights=length, minlength=n) / some, np.log1p(longest),
        share(SYMBOL[data]), share(data == 124), share(data == 35), share(data == 33), share(FULL_STOP[data]),
        share(DIGIT[data]), share(CAPITAL[data]), share(CAPITAL[data] | SMALL[data]), share(HIGH[data]),
        distinct, per_word(same), per_word(K.in_repeated_windows(of, hashes, 3)),
        per_word(K.in_repeated_windows(of, hashes, 8)), top / some,
        np.log1p(n_lines), n_words / n_lines, per_line(again), per_line(closed), per_line(line_words < 3),
        per_word(length > 20), per_word(marked),
    )
    return np.column_stack(columns).astype(np.float32)


def _batched(column: pa.Array) -> np.ndarray:
    data, at = K.buffers(column)
    parts = [statistics(piece, offsets) for piece, offsets in K.slices(data, at)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def text_statistics(column: pa.Array) -> pa.Array:
    rows = _batched(column)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


@dataclass
class Trees:
    """Complete binary trees of one depth, one row of nodes each: children of node i are 2i+1, 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Boost trees on the logistic loss, splits sought in histograms of ``bins`` quantile bins."""
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    p = float(np.mean(y)) if len(y) else 0.5
    empty = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, nodes)), 0.0, depth)
    empty.base = float(np.log(np.clip(p, 1e-3, 1 - 1e-3) / np.clip(1 - p, 1e-3, 1 - 1e-3)))
    if not len(y) or y.min() == y.max():
        return empty
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)])
    flat = binned + np.arange(m) * bins
    total = np.full(n, empty.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        gradient, weight = y - prob, prob * (1 - prob)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (m * bins) + flat).ravel()
            g = np.bincount(cell, np.repeat(gradient, m), wide * m * bins).reshape(wide, m, bins)
            h = np.bincount(cell, np.repeat(weight, m), wide * m * bins).reshape(wide, m, bins)
            left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            at_feature, at_bin = best // (bins - 1), best % (bins - 1)
            for k in range(wide):
                j, b = at_feature[k], at_bin[k]
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g = np.bincount(node, gradient, nodes)
        h = np.bincount(node, weight, nodes)
        value = rate * g / (h + ridge)
        total += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), empty.base, depth)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(described: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 5) -> Trees:
    """Trees fitted on the labelled rows of ``described`` (doc_id, statistics) that are not held out."""
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    trainable = described.filter(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.min("statistics").alias("statistics"))
    rows = keep(trainable.join(marked, "doc_id").select("doc_id", "statistics", "quality"), "labelled")
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.filter(uniform(F.col("doc_id"), "fit") < share).select("doc_id", "statistics", "quality")
    table = drawn.toArrow().sort_by("doc_id")
    discard(rows)
    x = np.array(table["statistics"].to_pylist(), np.float64).reshape(table.num_rows, len(STATISTICS))
    return fit(x, table["quality"].to_numpy().astype(np.float64))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row, settled: the only pass over the texts."""
    return keep(docs.select("doc_id", text_statistics(F.col("text")).alias("statistics")), "statistics")


def _scorer(trees: Trees):
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(trees.score(flat.reshape(len(column), len(STATISTICS))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    described = describe(docs)
    score = _scorer(train(described, labels, **training))
    scored = described.select(
        "doc_id", held_out(F.col("doc_id"), training.get("folds", 5)).alias("held_out"), score("statistics").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns unchanged.

    The trees are fitted on a settled table of statistics; the rows themselves are then scored in
    one narrow pass, so whole texts are never shuffled.
    """
    described = describe(docs)
    score = _scorer(train(described, labels, **training))
    discard(described)
    return docs.filter(score(text_statistics(F.col("text"))) >= threshold)
