"""Toxicity by multiple-instance learning: a document is a bag of sentences, its label is that of its worst one.

Each sentence has a logistic score over its words and their stems (the first four and six letters of longer words, so
that a rare inflection shares its stem's weight); a document's score is the noisy-or of its sentences,
``1 - prod(1 - p_s)``. Only document labels train the model, so the gradient itself finds the sentences that
explain a label, and the fitted model points at them afterwards (:func:`offending_sentences`).

Training takes at most ``max_train`` labelled documents, those of the smallest id hashes (a documented bound for
fitting; scoring covers every row). Defined results: a null text counts as empty; a text without words gets the
prior score of an empty bag (0); a null id counts as the empty text when folds are dealt; repeated rows and repeated
labels are kept as they are; without any usable labels every score is 0. Extra columns are ignored or, in
:func:`keep_clean`, passed through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import LOWER, fold_of, lean, range_hashes, spans, sums, table, text_chunks, text_or_empty

BITS = 18
MAX_TRAIN = 10_000
STEMS = (4, 6)
CUT = 0.7

#: every byte that is not part of a word: ASCII but letters and digits
_NOT_WORD = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
#: bytes that end a sentence
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def sentence_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hashed words of each sentence, each sentence's first word, each row's first sentence, the sentences' byte spans."""
    s_start, s_end, row_first = spans(data, offs, _STOP)
    w_start, w_end, _ = spans(data, np.unique(np.concatenate([offs, s_start])), _NOT_WORD)
    lower, chars = LOWER[data], np.flatnonzero((data & 0xC0) != 0x80)
    begun, chars = np.searchsorted(chars, w_start), np.append(chars, [len(data)] * (max(STEMS) + 1))
    found, at = [range_hashes(lower, w_start, w_end)], [w_start]
    for n in STEMS:
        end = chars[begun + n]
        longer = end < w_end
        found.append(range_hashes(lower, w_start[longer], end[longer]))
        at.append(w_start[longer])
    at = np.concatenate(at)
    order = np.argsort(at, kind="stable")
    words = (np.concatenate(found)[order] & np.uint64((1 << BITS) - 1)).astype(np.int32)
    return words, np.searchsorted(at[order], np.append(s_start, len(data))), row_first, (s_start, s_end)


def score_rows(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Document scores; sentence scores, their spans and each row's first sentence."""
    words, bounds, row_first, where = sentence_words(data, offs)
    hit = np.flatnonzero(model.weights[words])
    sent = np.searchsorted(bounds, hit, side="right") - 1
    pairs = np.unique(sent.astype(np.int64) << BITS | words[hit])  # a word counts once in a sentence
    z = np.bincount(pairs >> BITS, model.weights[pairs & ((1 << BITS) - 1)], len(bounds) - 1) + model.bias
    z[np.diff(bounds) == 0] = -np.inf
    none = np.logaddexp(0, z)
    return -np.expm1(-sums(none, row_first)), -np.expm1(-none), where, row_first


def fit(words: np.ndarray, bounds: np.ndarray, row_first: np.ndarray, label: np.ndarray, rounds: int = 60, l2: float = 2e-5, z_least: float = 4.0) -> Model:
    """Full-batch Adam on the documents' log loss under noisy-or.

    Only words whose share of toxic documents stands ``z_least`` standard errors above the base rate get a weight:
    a bag of many sentences can otherwise explain its label by any of its rare words.
    """
    size = 1 << BITS
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(size, np.float32), -np.inf)
    n_docs, n_sent = len(label), len(bounds) - 1
    in_docs, in_toxic = np.zeros(size), np.zeros(size)
    for a, b, y in zip(bounds[row_first[:-1]], bounds[row_first[1:]], label, strict=True):
        own = np.unique(words[a:b])
        in_docs[own] += 1
        in_toxic[own] += y
    rate = label.mean()
    often = (in_toxic >= 4) & (in_toxic - rate * in_docs >= z_least * np.sqrt(np.maximum(in_docs, 1) * rate * (1 - rate)))
    kept, index = np.flatnonzero(often), (np.cumsum(often) - 1).astype(np.int32)
    use = often[words]
    pairs = np.unique(np.repeat(np.arange(n_sent), np.diff(bounds))[use] << BITS | index[words[use]])
    feat, sent = (pairs & (size - 1)).astype(np.int32), (pairs >> BITS).astype(np.int32)
    w, b, y = np.zeros(len(kept)), -np.log(max(2.0, n_sent / max(1.0, label.sum()))), label.astype(np.float64)
    of_doc = np.repeat(np.arange(n_docs), np.diff(row_first))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(sent, w[feat], n_sent) + b
        none = np.logaddexp(0, z)
        total = np.bincount(of_doc, none, n_docs)
        # d loss / d total: 1 for a clean document, -1 / (e^total - 1) for a toxic one
        slope = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / n_docs
        by_sent = slope[of_doc] * (1 - np.exp(-none))
        g, gb = np.bincount(feat, by_sent[sent], len(kept)) + l2 * w, by_sent.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, c1, c2 = 0.3 * (1 - step / (rounds + 1)) + 0.01, 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    out = np.zeros(size, np.float32)
    out[kept] = w
    return Model(out, float(b))


_BAG = "label int, sizes array<int>, words binary"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            words, bounds, first, _ = sentence_words(data, offs)
            sizes = np.diff(bounds).astype(np.int32)
            rows = [(sizes[a:b], words[bounds[a] : bounds[b]].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(label[lo:hi], pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.binary())], ["label", "sizes", "words"])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``max_train`` of them."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(fold_of("doc_id", modulus) != held)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    # Repeated ids stay out of the bound: each chosen id gives one text.
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).drop("doc_id")
    got = rows.mapInArrow(lean(_bags), _BAG).toArrow().combine_chunks()
    sizes = got.column("sizes").combine_chunks()
    per_doc = np.concatenate([[0], np.cumsum(sizes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(got) else np.zeros(1, np.int64)
    flat = sizes.flatten().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0, np.int32)
    words = np.frombuffer(b"".join(got.column("words").to_pylist()), np.int32)
    return fit(words, np.concatenate([[0], np.cumsum(flat)]).astype(np.int64), per_doc, got.column("label").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and the worst sentence's score and text span, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                total, by_sent, (start, end), first = score_rows(model, data, offs)
                worst, text = np.zeros(hi - lo), [""] * (hi - lo)
                for i in np.flatnonzero(np.diff(first)):
                    k = first[i] + int(np.argmax(by_sent[first[i] : first[i + 1]]))
                    worst[i] = by_sent[k]
                    text[i] = data[start[k] : end[k]].tobytes().decode("utf-8", "replace").strip() if by_sent[k] >= 0.5 else ""
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(total), pa.array(worst), pa.array(text)], ["doc_id", "score", "worst_score", "worst_sentence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double, worst_score double, worst_sentence string")


def offending_sentences(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """doc_id, begin and end byte, score and text of each sentence that scores at least ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                _, by_sent, (start, end), first = score_rows(model, data, offs)
                hit = np.flatnonzero(by_sent >= cut)
                row = np.searchsorted(first, hit, side="right") - 1
                said = [data[start[k] : end[k]].tobytes().decode("utf-8", "replace") for k in hit]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(row)), pa.array(start[hit] - offs[row]), pa.array(end[hit] - offs[row]), pa.array(by_sent[hit]), pa.array(said, pa.string())], ["doc_id", "begin", "end", "score", "sentence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, begin long, end long, score double, sentence string")


def keep_clean(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose score is below ``cut``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                total[lo:hi] = score_rows(model, data, offs)[0]
            yield batch.filter(pa.array(total < cut))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "worst_score", "worst_sentence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))
