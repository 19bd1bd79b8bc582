"""Quality by Bradley-Terry ranking: of two documents the better one wins with probability sigmoid(s_i - s_j).

The document score ``s`` is additive over binned surface statistics of its text (letter case, punctuation kinds,
digits, word lengths, repetition of words, word pairs and lines). It is learned from preference pairs (a document
labelled 1 against one labelled 0) by logistic loss on the difference of their features. Pairs fix scores up to a
shift only, so the cut is a quantile: the share of training documents labelled 0 lies below it. The reported score
is a logistic curve through 0.7 at the cut.

Bin edges, loss and cut come from every labelled document outside the held-out fold and from every pair of a good and
a bad one; no pair is drawn. The loss of all pairs is a convolution of the two score histograms: a score is shared between
its two neighbours on a grid of 1/64 (coarser where scores spread over more than 8,192 steps), a pull is read between grid
points. A round of L-BFGS takes two passes over the bin codes. All sums are whole numbers, so neither the order nor the
spread of the rows changes the model: up to ``HERE`` rows are summed on the driver, more are summed by tasks.
``max_train`` is for callers who want a bound (the smallest id hashes); without it there is none.

Defined results: null and empty texts have all-zero statistics and get the score of such a text; a null id counts as the
empty text when folds are dealt; repeated rows are scored alike, rows of one id are one training document (that of the
least statistics as bytes); without both labels every score is 1. Extra columns are ignored or, in :func:`keep_good`,
passed through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import buffers, durable, fold_of, lean, mix64, range_hashes, spans, sums, table, text_chunks, text_or_empty

HERE = 20_000
CUT = 0.7
BINS = 12

_KINDS = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "space": [32], "line": [10], "stop": [ord(c) for c in ".,;:?'\"-"], "shout": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*@^~+=_`"], "bar": [ord(c) for c in "|\\/<>[]{}()"], "high": [*range(0xC0, 256)],
}
_KIND_OF = np.full(256, len(_KINDS), np.uint8)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND_OF[_bytes] = _i

_NOT_LINE = np.isin(np.arange(256), [10, 13])
NAMES = [*_KINDS, "other", "bytes", "words", "mean_word", "dev_word", "short", "long", "stutter", "distinct", "pairs", "lines", "distinct_lines", "capital_words"]


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(first) - 1)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of statistics a text, in the order of NAMES; shares are of bytes, words or lines."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    kinds = _KIND_OF[data]
    row = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(row * (len(_KINDS) + 1) + kinds, minlength=n * (len(_KINDS) + 1)).reshape(n, -1)
    start, end, first = spans(data, offs)
    length, words = (end - start).astype(float), np.diff(first).astype(float)
    h = range_hashes(data, start, end)
    same = np.zeros(len(h), bool)
    pair = np.zeros(len(h), np.uint64)
    if len(h):
        inner = np.ones(len(h), bool)
        inner[first[:-1][words > 0]] = False
        same[1:] = (h[1:] == h[:-1]) & inner[1:]
        pair[1:] = mix64(h[:-1] * np.uint64(3) + h[1:])
        pair[~inner] = h[~inner]
    l_start, l_end, l_first = spans(data, offs, _NOT_LINE)
    lines = np.diff(l_first).astype(float)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    mean = sums(length, first) / w
    capital = (_KIND_OF[data[start]] == 0) if len(start) else np.zeros(0, bool)
    columns = [*(counts / b[:, None]).T, np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(sums(length * length, first) / w - mean * mean, 0)), sums((length <= 3).astype(float), first) / w, sums((length >= 20).astype(float), first) / w, sums(same.astype(float), first) / w, _distinct(h, first) / w, _distinct(pair, first) / w, np.log1p(lines), _distinct(range_hashes(data, l_start, l_end), l_first) / np.maximum(lines, 1), sums(capital.astype(float), first) / w]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score s of each row of statistics."""
        s = np.zeros(len(x))
        for k in range(x.shape[1]):
            s += self.weights[k][np.searchsorted(self.edges[k], x[:, k], side="right")]
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.rank(x) - self.cut) * self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], x[:, k], side="right") for k in range(len(edges))], 1).astype(np.uint8)


def _sum_weights(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = np.zeros(len(codes))
    for k in range(codes.shape[1]):
        s += w[k * BINS + codes[:, k].astype(np.intp)]
    return s


def _pack(x: np.ndarray) -> pa.Array:
    """One binary value a row of the matrix."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _unpack(column: pa.Array, dtype: type) -> np.ndarray:
    return buffers(column)[0].view(dtype).reshape(len(column), len(NAMES))


_Sum = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Here:
    """Training rows as arrays: statistics or bin codes, and labels."""

    x: np.ndarray
    y: np.ndarray

    def total(self, run: _Sum) -> np.ndarray:
        return run(self.x, self.y)

    def coded(self, edges: np.ndarray) -> Here:
        return Here(_codes(self.x, edges), self.y)


@dataclass(frozen=True)
class Spread:
    """Training rows as a table of label and packed statistics or bin codes; tasks send sums of whole numbers only."""

    rows: DataFrame
    dtype: type = np.float64

    def total(self, run: _Sum) -> np.ndarray:
        dtype = self.dtype

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = None
            for batch in batches:
                more = run(_unpack(batch.column("x"), dtype), batch.column("label").to_numpy())
                part = more if part is None else part + more
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], ["part"])

        return sum(np.frombuffer(r.part, np.int64) for r in self.rows.mapInArrow(lean(each), "part binary").collect())

    def coded(self, edges: np.ndarray) -> Spread:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("label"), _pack(_codes(_unpack(batch.column("x"), np.float64), edges))], ["label", "x"])

        return Spread(durable(self.rows.mapInArrow(lean(each), "label int, x binary"), "quality-codes"), np.uint8)


_SIGN = np.uint64(1 << 63)


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _SIGN, keys ^ _SIGN, ~keys).view(np.float64)


def quantiles(rows: Here | Spread, n: int, columns: int, q: np.ndarray, values: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """Exact quantiles (numpy's linear ones) of every column: eight passes, each finds eight more bits of the order statistics."""
    at = (n - 1) * np.asarray(q, float)
    ranks = np.concatenate([np.floor(at), np.ceil(at)]).astype(np.int64)
    found = np.zeros((columns, len(ranks)), np.uint64)
    for shift in range(56, -1, -8):
        digits = np.arange(256, dtype=np.uint64) << np.uint64(shift)
        heads = [np.unique(f) for f in found]
        bounds = [(h[:, None] + digits).ravel() for h in heads]

        def count(x: np.ndarray, y: np.ndarray, bounds: list[np.ndarray] = bounds) -> np.ndarray:
            keys = _keys(values(x))
            return np.concatenate([np.bincount(np.searchsorted(b, keys[:, k], side="right"), minlength=len(b) + 1) for k, b in enumerate(bounds)])

        counts = np.split(rows.total(count), np.cumsum([len(b) + 1 for b in bounds])[:-1])
        for k in range(columns):
            below = np.cumsum(counts[k])[:-1].reshape(-1, 256)
            head = np.searchsorted(heads[k], found[k])
            found[k] += digits[(below[head] <= ranks[:, None]).sum(1) - 1]
    low, high = np.split(_doubles(found), 2, axis=1)
    t = at - np.floor(at)
    return np.where(t >= 0.5, high - (high - low) * (1 - t), low + (high - low) * t)


_SHARE, _PULL, _CELLS = 1 << 20, 1 << 30, 1 << 13


class PairLoss:
    """Mean logistic loss of all pairs of a good and a bad row, and its slope, at given weights."""

    def __init__(self, codes: Here | Spread, bad: int, good: int, size: int, l2: float) -> None:
        self.codes, self.n, self.size, self.l2 = codes, np.array([bad, good], float), size, l2

    def value(self, w: np.ndarray) -> tuple[float, tuple]:
        by = w.reshape(-1, BINS)
        low, high = by.min(1).sum(), by.max(1).sum()
        step = max(1 / 64, (high - low) / (_CELLS - 8))
        first, cells = np.floor(low / step) - 1, int(np.ceil((high - low) / step)) + 5

        def histogram(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
            t = _sum_weights(codes, w) / step - first
            cell = t.astype(np.int64)
            share = np.rint((t - cell) * _SHARE)
            cell += y * cells
            return (np.bincount(cell, _SHARE - share, 2 * cells) + np.bincount(cell + 1, share, 2 * cells)).astype(np.int64)

        bad, good = self.codes.total(histogram).reshape(2, cells) / (self.n[:, None] * _SHARE)
        apart = np.arange(1 - cells, cells) * step
        over = lambda h, kernel: np.convolve(h, kernel)[cells - 1 : 2 * cells - 1]
        lost = 1 / (1 + np.exp(np.clip(apart, -60, 60)))
        pull = np.stack([over(good, lost[::-1]), -over(bad, lost)])
        return float(good @ over(bad, np.logaddexp(0, -apart)) + self.l2 / 2 * (w @ w)), (w, first, step, pull)

    def slope(self, at: tuple) -> np.ndarray:
        w, first, step, pull = at
        size = self.size

        def pulls(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
            t = _sum_weights(codes, w) / step - first
            cell = t.astype(np.int64)
            own = np.rint((pull[y, cell] * (1 - (t - cell)) + pull[y, cell + 1] * (t - cell)) * _PULL)
            total = np.zeros(2 * size, np.int64)
            for k in range(codes.shape[1]):
                total += np.bincount(y * size + k * BINS + codes[:, k], own, 2 * size).astype(np.int64)
            return total

        return (self.codes.total(pulls).reshape(2, size) / (self.n[:, None] * _PULL)).sum(0) + self.l2 * w


def _descend(loss: PairLoss, w: np.ndarray, rounds: int, memory: int = 10, enough: float = 1e-5) -> np.ndarray:
    """L-BFGS with halved steps."""
    f, at = loss.value(w)
    g, past = loss.slope(at), []
    for _ in range(rounds):
        if np.abs(g).max() < enough:
            break
        d, a = -g, []
        for s, y in reversed(past):
            a.append((s @ d) / (s @ y))
            d = d - a[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 2.0 * BINS)
        for (s, y), b in zip(past, reversed(a), strict=True):
            d = d + (b - (y @ d) / (s @ y)) * s
        size = 1.0
        while True:
            new_f, at = loss.value(w + size * d)
            if new_f <= f + 1e-4 * size * (g @ d):
                break
            size /= 2
            if size < 1e-4:
                return w
        new_g = loss.slope(at)
        if (size * d) @ (new_g - g) > 0:
            past = [*past, (size * d, new_g - g)][-memory:]
        w, f, g = w + size * d, new_f, new_g
    return w


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, l2: float = 1e-4) -> Model:
    """The model of rows given as arrays."""
    return fit_rows(Here(x, np.asarray(y, np.int64)), int((y == 0).sum()), int((y == 1).sum()), rounds, l2)


def fit_rows(rows: Here | Spread, bad: int, good: int, rounds: int = 60, l2: float = 1e-4) -> Model:
    d, n = len(NAMES), bad + good
    edges = quantiles(rows, n, d, np.linspace(0, 1, BINS + 1)[1:-1]) if n else np.zeros((d, BINS - 1))
    if not good or not bad:
        return Model(edges, np.zeros((d, BINS)), -np.inf, 1.0)
    codes = rows.coded(edges)
    w = _descend(PairLoss(codes, bad, good, d * BINS, l2), np.zeros(d * BINS), rounds)
    cut = quantiles(codes, n, 1, np.array([bad / n]), lambda c: _sum_weights(c, w)[:, None])
    return Model(edges, w.reshape(d, BINS), float(cut[0, 0]), 1.0)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the packed statistics of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), _pack(features(data, offs))], ["doc_id", "x"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, max_train: int | None = None) -> Model:
    """Fit on all labelled documents outside the held-out fold, or on ``max_train`` of them."""
    return train_on(statistics(docs.where(fold_of("doc_id", modulus) != held)), labels, modulus, held, max_train)


def train_on(stats: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, max_train: int | None = None) -> Model:
    """:func:`train` over the table of :func:`statistics`; texts are not moved, statistics are."""
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(fold_of("doc_id", modulus) != held)
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label"))
    if max_train is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = stats.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x"))
    rows = durable(rows.select("label", "x"), "quality-train")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n > HERE:
        return fit_rows(Spread(rows.coalesce(min(64, n // 50_000 + 1))), n - good, good)
    got = rows.toArrow()
    return fit(_unpack(got.column("x"), np.float64), got.column("label").to_numpy())


def _score_stats(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch.column("x"), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x)), pa.array(model.rank(x))], ["doc_id", "score", "rank"])

    return stats.mapInArrow(lean(run), f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, rank double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and rank (the Bradley-Terry score), for every row."""
    return _score_stats(statistics(docs), model)


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose score is at least ``cut``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                total[lo:hi] = model.score(features(data, offs))
            yield batch.filter(pa.array(total >= cut))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = durable(statistics(docs), "quality-statistics")
    scored = _score_stats(stats, train_on(stats, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "rank")
