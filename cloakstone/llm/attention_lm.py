"""Language-model scoring with a small causal self-attention model, trained in numpy on subword ids.

Tokens of a text: its words, A-Z lower-cased, then one end.  Each word is cut into the ids of a
public subword tokenizer (a parameter, never trained).  The model predicts the next id in three
factors: the group of the id's class and the class within its group, both by one layer of causal attention
over the last ids plus the current one, and the id given its class, from counts over the whole training
corpus.  The most frequent ids are classes of their own; the others share classes by rank.  A text is scored in windows of
``Shape.window`` ids that move by ``Shape.stride``: every id is scored once, with at least
``window - stride`` ids of context unless the text has fewer, all windows of a slice in one batch of masked
attention.

All counts (words, ids, id pairs) cover every training document.  Every id is an input of its own.  The model
starts from the factored table of pair counts, in which ids beyond ``Shape.coarse`` share a row; then learners,
one a task, each run over their share of windows, and their weights are averaged in Spark by the windows (for an
input, by how often it was) they saw, for ``Shape.rounds`` rounds.  Every window of every training document is learned from
once, in one of the rounds.  There are ``Shape.learners`` learners, more for a corpus of over that many times
``Shape.share`` ids, so a task's work is bounded.  What reaches the driver is bounded by the vocabulary and the model, not by the corpus.

The base score needs the count of each word.  The ``Shape.head`` most frequent words are sent to the tasks
as hashes (a bounded list); the rest are summed by a join on the word's 64-bit hash.

Cases: a null or empty text has the end only.  A row whose id is null is scored but not learned from
and not held out.  Repeated rows count as often as they stand there.  An empty table gives
no rows; without training rows the counts are zero and the model is uniform over classes.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakstone.llm import kernels as K
from cloakstone.sources.session import keep

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
IDS, END = 32_000, 2  # of that tokenizer


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its training."""

    window: int = 32
    stride: int = 24
    symbols: int = IDS  # ids the model tells apart as input
    coarse: int = 1024  # of them, those with a row of their own in the table it starts from
    single: int = 960  # ids that are classes of their own
    classes: int = 1024
    groups: int = 32  # of equally many classes
    heads_width: int = 8
    hidden: int = 24
    head: int = 1 << 17
    learners: int = 16  # at least
    share: int = 4_000_000  # ids a learner gets in all rounds
    rounds: int = 2
    batch: int = 128
    rate: float = 0.01
    cache: int = 800_000


# --- words and ids -------------------------------------------------------------------------------


class Cutter:
    """Words to ids, each distinct word cut once while it is in the cache.

    The cache is sorted hashes with the slot of each, and per slot the place of its ids.
    """

    def __init__(self, model: bytes, limit: int):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ends, self.flat = np.array([0, 1], np.int64), array("H", [END])  # slot 0 is the end

    def cut(self, data: np.ndarray, begin, end, uniques, first) -> np.ndarray:
        """The slot of each of the sorted distinct words."""
        if len(self.known) > self.limit:
            self.clear()
        place = np.searchsorted(self.known, uniques)
        near = np.minimum(place, max(len(self.known) - 1, 0))
        there = self.known[near] == uniques if len(self.known) else np.zeros(len(uniques), bool)
        slots = np.zeros(len(uniques), np.int64)
        slots[there] = self.slot[near[there]]
        fresh = np.flatnonzero(~there)
        if len(fresh):
            raw = data.tobytes()
            at = first[fresh]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            cut = self.processor.encode(words, num_threads=1)
            for ids in cut:
                self.flat.extend(ids)
            slots[fresh] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(fresh))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in cut])])
            self.known = np.insert(self.known, place[fresh], uniques[fresh])
            self.slot = np.insert(self.slot, place[fresh], slots[fresh].astype(np.int32))
        return slots

    def spell(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of slots, and where each slot's ids end."""
        start = self.ends[slots]
        size = self.ends[slots + 1] - start
        ends = np.cumsum(size)
        where = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.array(self.flat, np.uint16)[where], ends


_CUTTERS: dict[int, Cutter] = {}


def cutter(model: bytes, limit: int) -> Cutter:
    """One per Python worker, kept from task to task."""
    key = hash((model, limit))
    if key not in _CUTTERS:
        _CUTTERS.clear()
        _CUTTERS[key] = Cutter(model, limit)
    return _CUTTERS[key]


def forget_words() -> None:
    """Give back what cutting words holds in this Python worker, where later stages need the memory."""
    _CUTTERS.clear()
    pa.default_memory_pool().release_unused()


def word_hashes(data: np.ndarray, at: np.ndarray):
    low = K.LOWER[data]
    begin, end = K.words(low, at)
    return low, begin, end, K.span_hashes(low, begin, end)


def trains(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash) and c over all training texts, summed per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.buffers(batch["text"])
            found = [word_hashes(*piece)[3] for piece in K.slices(data, at)]
            word, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": word.view(np.int64), "c": c.astype(np.int64)})

    rows = training.select("text").mapInArrow(count, "word long, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


SPELLED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
        T.StructField("rare_n", T.ArrayType(T.LongType())),
    ]
)


def _speller(model: bytes, cache: int, head: np.ndarray, head_c: np.ndarray, end_c: int, total: float):
    """Ids, and the base score of the head words; the other words are listed with their counts."""

    @F.arrow_udf(SPELLED)
    def spelled(column: pa.Array) -> pa.Array:
        cut = cutter(model, cache)
        data, at = K.buffers(column)
        n_tokens, n_known, base, ids, rare, rare_n = [], [], [], [], [], []
        for piece, offsets in K.slices(data, at):
            n = len(offsets) - 1
            low, begin, end, hashes = word_hashes(piece, offsets)
            of = K.owners(offsets, begin)
            uniques, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            slots = cut.cut(low, begin, end, uniques, first)[inverse]
            bounds = np.searchsorted(begin, offsets)
            flat, ends = cut.spell(np.insert(slots, bounds[1:], 0))
            last = np.r_[0, ends[bounds[1:] + np.arange(n)]] * 2
            raw = flat.tobytes()
            ids += [raw[a:b] for a, b in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]
            place = np.minimum(np.searchsorted(head, uniques), max(len(head) - 1, 0))
            known = (head[place] == uniques if len(head) else np.zeros(len(uniques), bool))[inverse]
            c = (head_c[place] if len(head) else np.zeros(len(uniques)))[inverse]
            worth = np.where(known, np.log10((c + 0.1) / total), 0.0)
            words = np.bincount(of, minlength=n)
            n_tokens.append(words + 1)
            n_known.append(np.bincount(of[known], minlength=n) + (end_c > 0))
            base.append(np.bincount(of, weights=worth, minlength=n) + np.log10((end_c + 0.1) / total))
            left = np.flatnonzero(~known)
            _, one, times = np.unique(K.keyed(of[left], hashes[left]), return_index=True, return_counts=True)
            order = np.argsort(of[left[one]], kind="stable")
            one, times = left[one[order]], times[order]
            cuts = np.searchsorted(of[one], np.arange(n + 1))
            rare.append((hashes[one].view(np.int64), np.diff(cuts)))
            rare_n.append(times)

        def joined(parts, kind):
            return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)

        offsets = np.r_[0, np.cumsum(joined([r[1] for r in rare], np.int64))].astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array(joined(n_tokens, np.int64)),
                pa.array(joined(n_known, np.int64)),
                pa.array(joined(base, np.float64)),
                pa.array(ids, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(joined([r[0] for r in rare], np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(joined(rare_n, np.int64))),
            ],
            names=[f.name for f in SPELLED],
        )

    return spelled


# --- the model -----------------------------------------------------------------------------------


MASKED = -1e4  # added to scores that must not count; their exponential is exactly zero, never a denormal number
OTHERS = ("o", "u", "b", "g", "a", "t")  # weights that do not belong to an input


class Model:
    """Weights; ``symbol`` and ``cls`` map ids to input symbols and classes, ``inside`` is log p(id | class)."""

    def __init__(self, shape: Shape, counts: np.ndarray):
        self.shape = shape
        order = np.lexsort((np.arange(IDS), -counts))
        rank = np.empty(IDS, np.int64)
        rank[order] = np.arange(IDS)
        self.symbol = np.minimum(rank, shape.symbols - 1).astype(np.int32)
        self.coarse = np.minimum(np.arange(shape.symbols), shape.coarse - 1)  # of a symbol
        shared = shape.classes - shape.single
        edges = np.geomspace(shape.single, IDS, shared + 1)[1:-1]
        self.cls = np.where(rank < shape.single, rank, shape.single + np.searchsorted(edges, rank, "right")).astype(np.int32)
        weight = counts + 0.1
        self.inside = np.log(weight / np.bincount(self.cls, weight, shape.classes)[self.cls])
        prior = np.bincount(self.cls, weight, shape.classes)
        d, h, m, c = shape.heads_width, shape.hidden, int(self.coarse[-1]) + 1, shape.classes
        rng = np.random.default_rng(7)
        self.w = {
            **{name: rng.normal(0, 0.3, (m, d))[self.coarse] for name in "qkv"}, "r": np.zeros((shape.symbols, h)), "o": rng.normal(0, 0.1, (d, h)),
            "u": rng.normal(0, 0.1, (h, c)), "b": self._inner(np.log(prior / prior.sum())),
            "g": rng.normal(0, 0.1, (h, shape.groups)), "a": self._outer(np.log(prior / prior.sum())),
            "t": np.zeros(shape.window),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _outer(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of each group, from that of the classes (last axis)."""
        return np.log(np.exp(log_p).reshape(*log_p.shape[:-1], self.shape.groups, -1).sum(-1))

    def _inner(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of each class within its group."""
        return log_p - np.repeat(self._outer(log_p), self.shape.classes // self.shape.groups, -1)

    def start_from(self, pairs: np.ndarray) -> None:
        """Factor the table of (coarse symbol, next class) counts: the model without attention."""
        row = pairs.sum(1, keepdims=True)
        prior = pairs.sum(0) + 0.1
        prior = prior / prior.sum()
        log_p = np.log((pairs + 20 * prior) / (row + 20))
        here = np.hstack([self._outer(log_p) - self._outer(np.log(prior)), self._inner(log_p) - self._inner(np.log(prior))])
        trust = np.sqrt(row / max(1.0, row.max()) + 1e-4)
        left, size, right = np.linalg.svd(here * trust, full_matrices=False)
        h, groups = self.shape.hidden, self.shape.groups
        scale = np.sqrt(size[:h])
        self.w["r"] = (left[:, :h] * scale / trust)[self.coarse].astype(np.float32)
        out = (right[:h] * scale[:, None]).astype(np.float32)
        self.w["g"], self.w["u"] = out[:, :groups].copy(), out[:, groups:].copy()

    def inputs(self) -> np.ndarray:
        """All that an input symbol looks up, side by side."""
        return np.hstack([self.w[name] for name in "qkvr"])

    def set_inputs(self, table: np.ndarray) -> None:
        at = 0
        for name in "qkvr":
            width = self.w[name].shape[1]
            self.w[name] = np.ascontiguousarray(table[:, at : at + width])
            at += width

    def others(self) -> np.ndarray:
        """The weights that every window touches, in one array."""
        return np.concatenate([self.w[k].ravel() for k in OTHERS])

    def set_others(self, flat: np.ndarray) -> None:
        at = 0
        for k in OTHERS:
            size = self.w[k].size
            self.w[k] = flat[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size

    def bias(self, queries: int) -> np.ndarray:
        """What is added to the scores of the last ``queries`` positions: by distance, and no look ahead."""
        width = self.shape.window
        ago = np.arange(width - queries, width)[:, None] - np.arange(width)[None, :]
        return np.where(ago >= 0, self.w["t"][np.abs(ago)], MASKED).astype(np.float32)

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean loss over a batch of whole windows (symbols, classes, which are real)."""
        table = self.inputs()
        used, rows, out = self.gradients(table, x, y, real)
        whole = np.zeros_like(table)
        whole[used] = rows
        d = self.shape.heads_width
        return out | {"q": whole[:, :d], "k": whole[:, d : 2 * d], "v": whole[:, 2 * d : 3 * d], "r": whole[:, 3 * d :]}

    def gradients(self, table: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray):
        """The same: rows of ``table`` that were used, their gradients, and those of the other weights.

        Rows of one group of classes go through one small product each; rows of one input are summed
        in sorted runs.
        """
        w, (n, width), d = self.w, x.shape, self.shape.heads_width
        looked = table.take(x.ravel(), 0)
        q, k, v = (looked[:, a : a + d].reshape(n, width, d) for a in (0, d, 2 * d))
        p = q @ k.transpose(0, 2, 1)
        p += self.bias(width)
        if not real.all():
            np.copyto(p, MASKED, where=~real[:, None, :])
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        a = p @ v
        z = looked[:, 3 * d :] + a.reshape(-1, d) @ w["o"]
        mean = (real.ravel() / max(1, real.sum())).astype(z.dtype)[:, None]
        every, of_group = np.arange(len(z)), self.shape.classes // self.shape.groups

        def wrong(logit: np.ndarray, target: np.ndarray, mean: np.ndarray) -> np.ndarray:
            ones = np.ones((logit.shape[1], 1), logit.dtype)
            np.minimum(logit, 60, out=logit)  # keeps the exponentials finite
            np.exp(logit, out=logit)
            logit *= mean / (logit @ ones)
            logit[every, target] -= mean[:, 0]
            return logit

        groups = self.shape.groups
        group, member = np.divmod(y.ravel(), of_group)
        outer = wrong(z @ w["g"] + w["a"], group, mean)
        order = np.argsort(group.astype(np.int16), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(groups + 1)).tolist()
        u = w["u"].reshape(-1, groups, of_group).transpose(1, 0, 2).copy()
        b = w["b"].reshape(groups, of_group)
        zs, logit, dzs, dz = z[order], np.empty((len(z), of_group), z.dtype), np.empty_like(z), np.empty_like(z)
        spans = [(i, slice(bounds[i], bounds[i + 1])) for i in range(groups) if bounds[i] < bounds[i + 1]]
        for i, span in spans:
            np.matmul(zs[span], u[i], out=logit[span])
        logit += b[group[order]]
        inner = wrong(logit, member[order], mean[order])
        gu, gb = np.zeros_like(u), np.zeros_like(b)
        for i, span in spans:
            np.matmul(inner[span], u[i].T, out=dzs[span])
            np.matmul(zs[span].T, inner[span], out=gu[i])
        gb[[i for i, _ in spans]] = np.add.reduceat(inner, [span.start for _, span in spans])
        dz[order] = dzs
        dz += outer @ w["g"].T
        flat_a = a.reshape(-1, d)
        flat_da = dz @ w["o"].T
        da = flat_da.reshape(n, width, d)
        ds = da @ v.transpose(0, 2, 1)
        ds -= (flat_da * flat_a).sum(1).reshape(n, width, 1)
        ds *= p
        wide = np.empty_like(looked)
        for at, part in ((0, ds @ k), (d, ds.transpose(0, 2, 1) @ q), (2 * d, p.transpose(0, 2, 1) @ da)):
            wide[:, at : at + d] = part.reshape(-1, d)
        wide[:, 3 * d :] = dz
        symbols = x.ravel().astype(np.uint16)
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        ago = np.subtract.outer(np.arange(width), np.arange(width))
        others = {
            "o": flat_a.T @ dz, "u": gu.transpose(1, 0, 2).reshape(w["u"].shape), "b": gb.ravel(),
            "g": z.T @ outer, "a": outer.sum(0), "t": np.bincount(ago[ago >= 0], ds.sum(0)[ago >= 0], width),
        }
        return symbols[first].astype(np.int64), np.add.reduceat(wide[order], first), others

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of each text; ``at`` are the offsets of the texts' ids."""
        w, shape = self.w, self.shape
        width, stride = shape.window, shape.stride
        context = width - stride
        pad = shape.symbols
        size = np.diff(at)
        n_windows = -(-size // stride)
        total = np.zeros(len(size))
        if not n_windows.sum():
            return total
        of = np.repeat(np.arange(len(size)), n_windows)
        order = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        first = at[of] + order * stride - context
        # The input at a position is the id before it; before the first there is an end, before that nothing.
        previous = np.r_[END, ids[:-1]].astype(np.int64) if len(ids) else ids.astype(np.int64)
        previous[at[:-1]] = END
        x_all = self.symbol[previous]
        tables = [np.vstack([w[n], np.zeros((1, w[n].shape[1]), np.float32)]) for n in "qkvr"]
        one = np.ones((len(tables[0]), 1), np.float32)
        query = np.hstack([tables[0], one])
        hidden = np.zeros_like(one)
        hidden[pad] = MASKED
        key, value = np.hstack([tables[1], hidden]), np.hstack([tables[2], one])
        direct = np.hstack([tables[3], one])  # the last column meets the class bias
        groups, width_of = shape.groups, shape.classes // shape.groups
        inner = np.vstack([w["u"], w["b"]]).reshape(-1, groups, width_of).transpose(1, 0, 2).copy()
        outer = np.vstack([w["g"], w["a"]])
        spread = np.hstack([w["o"], np.zeros((len(w["o"]), 1), np.float32)])
        bias = self.bias(stride)
        # Few windows at a time and a buffer used again: the arrays stay in the cache.
        most = 96
        scores = np.empty((most, stride, width), np.float32)
        rows = np.arange(most * stride)
        for a in range(0, len(of), most):
            owner = of[a : a + most]
            n = len(owner)
            where = first[a : a + most, None] + np.arange(width)
            inside = (where >= at[owner][:, None]) & (where < at[owner + 1][:, None])
            np.clip(where, 0, len(ids) - 1, out=where)
            x = np.where(inside, x_all[where], pad)
            ask = x[:, context:]
            e = scores[:n]
            np.matmul(query.take(ask, 0, mode="clip"), key.take(x, 0, mode="clip").transpose(0, 2, 1), out=e)
            e += bias
            np.exp(e, out=e)
            mixed = np.matmul(e, value.take(x, 0, mode="clip")).reshape(n * stride, -1)
            attended = mixed[:, :-1] / np.maximum(mixed[:, -1:], 1e-30)
            z = direct.take(ask.ravel(), 0, mode="clip")
            z += attended @ spread
            target = ids[where[:, context:].ravel()]
            cls = self.cls[target]
            group = cls // width_of
            logit = z @ outer
            picked = logit[rows[: len(z)], group]
            np.exp(logit, out=logit)
            log_p = picked - np.log(logit.sum(1)) + self.inside[target]
            # Within the group: the rows of one group together, one small product each.
            order = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[order], np.arange(groups + 1))
            sorted_z, member = z[order], (cls % width_of)[order]
            logit = np.empty((len(z), width_of), np.float32)
            for k in range(groups):
                np.matmul(sorted_z[bounds[k] : bounds[k + 1]], inner[k], out=logit[bounds[k] : bounds[k + 1]])
            picked = logit[rows[: len(z)], member]
            np.exp(logit, out=logit)
            log_p[order] += picked - np.log(logit.sum(1))
            log_p *= inside[:, context:].ravel()
            total += np.bincount(np.repeat(owner, stride), weights=log_p, minlength=len(size))
        return total


def learn(model: Model, windows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Adam over batches of windows; how many there were, and how often each input.

    Rows of inputs are updated where a batch uses them.  Weights stay within bounds that keep the
    exponentials finite.
    """
    table = model.inputs()
    edge = np.repeat([2.5, 8.0], [3 * model.shape.heads_width, model.shape.hidden]).astype(np.float32)
    flat = model.others()
    limit = np.concatenate([np.full(model.w[k].size, 2.5 if k == "t" else 8.0 if k in "ug" else 40.0, np.float32) for k in OTHERS])
    mean, square = np.zeros_like(table), np.zeros_like(table)
    flat_mean, flat_square = np.zeros_like(flat), np.zeros_like(flat)
    seen, uses = 0, np.zeros(len(table), np.int64)
    for n, (x, y, real) in enumerate(windows, 1):
        seen += len(x)
        uses += np.bincount(x[real], minlength=len(table))
        rate = np.float32(model.shape.rate * min(1.0, n / 10) / np.sqrt(1 + n / 50))
        rise, spread = np.float32(1 / (1 - 0.9**n)), np.float32(1 / (1 - 0.99**n))

        def change(m: np.ndarray, s: np.ndarray, g: np.ndarray) -> np.ndarray:
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.99)
            s += np.float32(0.01) * (g * g)
            return rate * (m * rise) / (np.sqrt(s * spread) + np.float32(1e-8))

        used, rows, others = model.gradients(table, x, y, real)
        m, s = mean[used], square[used]
        table[used] = np.clip(table[used] - change(m, s, rows), -edge, edge)
        mean[used], square[used] = m, s
        g = np.concatenate([others[k].ravel() for k in OTHERS]).astype(np.float32)
        flat -= change(flat_mean, flat_square, g)
        np.clip(flat, -limit, limit, out=flat)
        model.set_others(flat)
    model.set_inputs(table)
    return seen, uses


# --- on the corpus -------------------------------------------------------------------------------


def _id_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint16) if len(data) else np.zeros(0, np.uint16), (offsets - offsets[0]).astype(np.int64) // 2


def _summed(rows: DataFrame, counted, size: int) -> np.ndarray:
    """Sum count vectors over the partitions: each task sends its filled cells, Spark adds them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += counted(*_id_arrays(batch["ids"]))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int64), "n": total[cell]})

    table = rows.select("ids").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size)
    total[table["cell"].to_numpy()] = table["n"].to_numpy()
    return total


def _shifted(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    previous = np.r_[np.uint16(END), ids[:-1]] if len(ids) else ids
    previous[at[:-1]] = END
    return previous


def training_windows(spelled: DataFrame, shape: Shape) -> DataFrame:
    """Every window of every text, after the id before it: doc_id, at, place, learner, round, ids.

    Each is for one learner in one round, by hash of its document and offset; ``place`` is its order there.
    """
    size, end = F.length("ids") / 2, F.lit(END.to_bytes(2, "little"))

    def window(at):
        before = F.when(at > 0, F.substring("ids", at * 2 - 1, 2)).otherwise(end)
        return F.struct(at.alias("at"), F.concat(before, F.substring("ids", at * 2 + 1, F.lit(shape.window * 2))).alias("ids"))

    offsets = F.sequence(F.lit(0), size.cast("int") - 1, F.lit(shape.window))
    rows = (
        spelled.filter(F.length("ids") > 0)
        .select("doc_id", F.explode(F.transform(offsets, window)).alias("w"))
        .select("doc_id", "w.at", "w.ids")
    )

    def drawn(name, n):
        return F.pmod(F.xxhash64("doc_id", "at", F.lit(name)), F.lit(n))

    return rows.select(
        "doc_id", "at", F.xxhash64("doc_id", "at").alias("place"), drawn("learner", shape.learners).alias("learner"),
        drawn("round", shape.rounds).alias("round"), "ids",
    )


PART = 32  # inputs whose weights travel in one row


def _weighted(model: Model, seen: int, uses: np.ndarray) -> pa.RecordBatch:
    """A learner's weights times what they count for, and the counts, in small rows.

    Parts from 0 on are inputs, as floats, without those that the learner never saw; parts below 0 are
    pieces of the other weights, as doubles.
    """
    table = np.hstack([model.inputs(), np.ones((len(uses), 1), np.float32)]) * uses[:, None].astype(np.float32)
    others = np.append(model.others(), 1.0) * float(seen)
    size = PART * table.shape[1] // 2  # as many bytes
    rows = {a // PART: table[a : a + PART] for a in range(0, len(table), PART) if uses[a : a + PART].any()}
    rows |= {-1 - a // size: others[a : a + size] for a in range(0, len(others), size)}
    return _parts(rows)


def _parts(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    sums = pa.array([r.tobytes() for r in rows.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), sums], names=["part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each part as doubles; what is held is one sum a part, however many learners there are."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch["part"].to_pylist(), batch["sums"], strict=True):
            row = np.frombuffer(sums.as_buffer(), np.float32 if part >= 0 else np.float64)
            if part in total:
                total[part] += row
            else:
                total[part] = row.astype(np.float64)
    yield _parts(total)


def average(model: Model, parts: dict[int, np.ndarray]) -> None:
    """Load the mean of all learners' weights; an input that none of them saw keeps its own."""
    table = model.inputs()
    for part, sums in parts.items():
        if part >= 0:
            sums = sums.reshape(-1, table.shape[1] + 1)
            used = np.flatnonzero(sums[:, -1])
            table[part * PART + used] = (sums[used, :-1] / sums[used, -1:]).astype(np.float32)
    model.set_inputs(table)
    others = np.concatenate([parts[i] for i in range(-1, min(parts) - 1, -1)])
    model.set_others(others[:-1] / others[-1])


def fit(spelled: DataFrame, shape: Shape) -> Model:
    """The model, from the training rows of ``spelled`` (doc_id, ids)."""
    counts = _summed(spelled, lambda ids, at: np.bincount(ids, minlength=IDS), IDS)
    shape = replace(shape, learners=max(shape.learners, math.ceil(counts.sum() / shape.share)))
    model = Model(shape, counts)
    rows, c = int(model.coarse[-1]) + 1, shape.classes
    coarse, cls = model.coarse[model.symbol], model.cls

    def pairs(ids, at):
        return np.bincount(coarse[_shifted(ids, at)].astype(np.int64) * c + cls[ids], minlength=rows * c)

    model.start_from(_summed(spelled, pairs, rows * c).reshape(rows, c))
    windows = training_windows(spelled, shape)
    for turn in range(shape.rounds):
        now = model

        def train(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            forget_words()

            def arrays():
                for batch in batches:
                    ids, at = _id_arrays(batch["ids"])
                    for a in range(0, len(at) - 1, shape.batch):
                        begin, stop = at[a : a + shape.batch], at[a + 1 : a + 1 + shape.batch][: len(at) - 1 - a]
                        begin = begin[: len(stop)]
                        where = begin[:, None] + np.arange(shape.window)
                        real = where + 1 < stop[:, None]
                        where = np.minimum(where, len(ids) - 1)
                        after = np.minimum(where + 1, len(ids) - 1)
                        yield now.symbol[ids[where]], now.cls[ids[after]], real

            seen, uses = learn(now, arrays())
            if seen:
                yield _weighted(now, seen, uses)

        mine = windows.filter(F.col("round") == turn).select(F.col("learner").cast("int"), "place", "ids")
        spread = mine.repartitionById(shape.learners, "learner").sortWithinPartitions("place")
        kind = "part int, sums binary"
        sums = spread.mapInArrow(train, kind).repartition("part").mapInArrow(_added, kind).collect()
        if sums:
            average(model, {r["part"]: np.frombuffer(r["sums"], np.float64) for r in sums})
    return model


def score_texts(docs: DataFrame, shape: Shape = Shape(), tokenizer: str = TOKENIZER, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    with open(tokenizer, "rb") as file:  # on the driver; the tasks get its bytes
        spm = file.read()
    docs = docs.select("doc_id", "text")
    training = docs.filter(trains(F.col("doc_id"), folds))
    counts = keep(word_counts(training), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end_c = training.count()
    n, v = sums["n"] + end_c, sums["v"] + (end_c > 0)
    total = n + 0.1 * (v + 1)
    top = counts.orderBy(F.desc("c"), "word").limit(shape.head).toArrow().sort_by("word")
    head = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(head)
    head, head_c = head[order], top["c"].to_numpy()[order].astype(np.float64)
    spell = _speller(spm, shape.cache, head, head_c, end_c, total)
    spelled = keep(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), spell("text").alias("s")).select(
            "doc_id", "row", "s.*"
        ),
        "spelled",
    )
    model = fit(spelled.filter(trains(F.col("doc_id"), folds)).select("doc_id", "ids"), shape)
    rare = spelled.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times")
    )
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(float(total)))).alias("tail_base"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        )
    )

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        ids, at = _id_arrays(column)
        out = [
            model.score(ids[at[a] : at[b]], at[a : b + 1] - at[a])
            for a, b in _groups(at, 1 << 17)
        ]
        return pa.array(np.concatenate(out) / np.log(10) if out else np.zeros(0))

    # Scored before the join, so that no ids are shuffled.
    rows = spelled.select("row", "doc_id", "n_tokens", "n_known", "base", scored("ids").alias("score"))
    return rows.join(tail, "row", "left").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _groups(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` ids."""
    a, n = 0, len(at) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1))
        yield a, b
        a = b
