"""Language-model scores by subword lattices: a word's probability is the sum over all its segmentations.

The pieces and their first weights come from an existing vocabulary. Its file gives ranks for scores, so a piece of rank
r weighs 1 / (r + 10); pieces that start a word and pieces inside one share a unit of probability each. These weights
stay in the model as a Dirichlet prior worth ``PRIOR`` uses, to which expectation-maximisation adds the expected uses
over the distinct training words (in fixed point, so that sums don't depend on their order). Each class z, a value of a
column (a language; every value that occurs in training rows is a class), has such a lattice. The probability that a
lattice gives a word is found by forward recursion in log space, ``alpha[e] = logsumexp over s of alpha[s] + log p(piece
s..e)``, for all words of one length at once.

Beside the lattices stand counts of the training rows. With c occurrences of a word, W running and V distinct words, N
tokens (words and ends) and a discount d, of all rows or of a class:

    p0(w)   = (max(c - d, 0) + (d V + 1/2) * sum over z of share(z) * lattice_z(w)) / (W + 1/2)
    p(w|z)  = (max(c_z - d_z, 0) + (d_z V_z + 1/2) * (p0(w) + lattice_z(w)) / 2) / (N_z + 1/2)
    p(end|z) = documents_z / (N_z + 1/2)

so the lattices carry what the counts leave for unseen words. The class of a document is not given to its score: that
is the marginal log10 of the sum over z of share(z) * p(text|z).

Counts and scores cover every word of every document. Words are counted by partial aggregation; the commonest words
(a table of at most ``CELLS`` numbers) are scored where the documents are read, all others by a join on the word's
64-bit hash. A row holds a number a class: a column of up to some hundred values is meant.

Defined results: null and empty texts have one token, the end; repeated rows are counted and scored each; a null id
counts as the empty text when folds are dealt; a null class is a class of its own; classes without training rows are no
classes; with no training rows at all, half of the mass goes to the end and half to the lattice, and base scores are 0.
Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import LOWER, buffers, durable, fold_of, lean, mix64, range_hashes, spans, table, text_chunks, text_or_empty
from readloom.llm.pieces import Keys

VOCABULARY = "piece_bpe_32k.model"
CELLS = 3_200_000
ROUNDS = 2
#: uses of pieces that the vocabulary's scores are worth
PRIOR = 1000.0
#: the share of pieces that end a word, before any are counted
STOP = 0.3
_UNIT = float(1 << 24)
#: the byte that stands for a word's start; white space never occurs in a word
_START = 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(h * _BASE + c.astype(np.uint64) + np.uint64(1))


# ---- lattice ------------------------------------------------------------------------------------


@dataclass
class Lattice:
    """Pieces as bytes (word-start pieces begin with the start byte) and their log probabilities."""

    pieces: list[bytes]
    logp: np.ndarray
    log_stop: float
    log_go: float
    prior: np.ndarray  #: the vocabulary's own probabilities
    keys: Keys | None = field(default=None, repr=False)
    longest: int = 0

    def __post_init__(self) -> None:
        if self.keys is not None:
            return
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_size.setdefault(len(p), []).append(i)
        keys = np.zeros(len(self.pieces), np.uint64)
        for size, own in by_size.items():
            raw = np.frombuffer(b"".join(self.pieces[i] for i in own), np.uint8).reshape(-1, size)
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = _extend(h, raw[:, k])
            keys[own] = h
        self.keys, self.longest = Keys(keys), max(by_size)

    def _pieces_of(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each end place, the first start looked at and the pieces from each start to there (-1: none)."""
        n, length = words.shape
        out, h = [], np.zeros((n, length), np.uint64)
        for end in range(1, length + 1):
            low = max(0, end - self.longest)
            h[:, low:end] = _extend(h[:, low:end], words[:, end - 1 : end])
            out.append((low, self.keys.find(h[:, low:end].reshape(-1)).reshape(n, -1)))
        return out

    def _forward(self, words: np.ndarray, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
        n, length = words.shape
        alpha, logp = np.full((n, length + 1), -np.inf), np.append(self.logp + self.log_go, -np.inf)
        alpha[:, 0] = -self.log_go  # no step before the first piece
        for end, (low, ids) in enumerate(found, 1):
            value = alpha[:, low:end] + logp[ids]
            top = value.max(1, keepdims=True)
            top[~np.isfinite(top)] = 0
            with np.errstate(divide="ignore"):
                alpha[:, end] = np.log(np.exp(value - top).sum(1)) + top[:, 0]
        return alpha

    def log_words(self, words: np.ndarray, found: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
        """Natural-log probabilities of equal-length words (bytes with the start byte, one row each)."""
        return self._forward(words, found or self._pieces_of(words))[:, -1] + self.log_stop

    def expect(self, words: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, in units of 2**-24."""
        found = self._pieces_of(words)
        alpha, logp = self._forward(words, found), np.append(self.logp + self.log_go, -np.inf)
        n, length = words.shape
        beta = np.full((n, length + 1), -np.inf)
        beta[:, -1] = -alpha[:, -1]
        counts = np.zeros(len(self.pieces) + 1)
        for end in range(length, 0, -1):
            low, ids = found[end - 1]
            through = logp[ids] + beta[:, end : end + 1]
            uses = np.rint(np.exp(np.minimum(0, alpha[:, low:end] + through)) * _UNIT)
            counts += np.bincount(np.where(ids < 0, len(self.pieces), ids).ravel(), uses.ravel(), len(counts))
            beta[:, low:end] = np.logaddexp(beta[:, low:end], through)
        return counts[:-1].astype(np.int64)

    def learned(self, uses: np.ndarray, words: int) -> Lattice:
        """The weights after these uses by ``words`` words and the prior; start pieces and inner pieces apart."""
        first = np.array([p[0] == _START for p in self.pieces])
        logp = np.empty(len(uses))
        for own in (first, ~first):
            c = uses[own] / _UNIT + PRIOR * self.prior[own]
            logp[own] = np.log(c / c.sum())
        stop = min(0.99, max(0.01, words / max(uses.sum() / _UNIT, 1.0)))
        return replace(self, logp=logp, log_stop=float(np.log(stop)), log_go=float(np.log1p(-stop)))


def vocabulary(name: str = VOCABULARY, stop: float = STOP) -> Lattice:
    """A lattice over an existing SentencePiece vocabulary, its single bytes included, weighted by its scores."""
    import sentencepiece

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    m = sentencepiece.SentencePieceProcessor(model_file=name)
    weight: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or "▁" in piece[1:]:
            continue
        raw = piece.replace("▁", chr(_START)).encode()
        weight[raw] = max(weight.get(raw, 0.0), 1.0 / (10.0 + min(1e6, max(0.0, -m.get_score(i)))))
    for b in [*range(256)]:
        if b != _START:
            weight.setdefault(bytes([b]), 1e-6)
    weight.setdefault(bytes([_START]), 1e-6)
    pieces = sorted(weight)
    w, first = np.array([weight[p] for p in pieces]), np.array([p[0] == _START for p in pieces])
    total = np.where(first, w[first].sum(), w[~first].sum())
    return Lattice(pieces, np.log(w / total), float(np.log(stop)), float(np.log1p(-stop)), w / total)


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of a column of words, by length, in blocks of bounded size."""
    data, offs = buffers(column)
    size = np.diff(offs)
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        step = max(1, 100_000 // (int(length) + 1))
        for lo in range(0, len(own), step):
            rows = own[lo : lo + step]
            words = np.full((len(rows), length + 1), _START, np.uint8)
            words[:, 1:] = data[offs[rows][:, None] + np.arange(length)]
            yield rows, words


# ---- counts -------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        train, kind = batch.column("train").to_numpy(zero_copy_only=False), batch.column("kind").to_numpy()
        for lo, hi, data, offs in text_chunks(batch.column("text"), 1 << 22):
            data = LOWER[data]
            start, end, first = spans(data, offs)
            if not len(start):
                continue
            z = np.repeat(kind[lo:hi], np.diff(first))
            h = mix64(range_hashes(data, start, end) + z.astype(np.uint64))
            _, rep, back = np.unique(h, return_index=True, return_inverse=True)
            used = np.repeat(train[lo:hi], np.diff(first))
            cuts = np.column_stack([start, end]).ravel().astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).take(pa.array(2 * rep)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([words, pa.array(z[rep], pa.int32()), pa.array(np.bincount(back, used, len(rep)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(rep)).astype(np.int64))], ["word", "kind", "trained", "n"])


def count_words(docs: DataFrame, kinds: int) -> DataFrame:
    """word (lower-cased bytes), its count in all rows, in training rows, and in training rows of each class."""
    parts = docs.select("train", "kind", "text").mapInArrow(lean(_count_words), "word binary, kind int, trained long, n long")
    by = [F.sum(F.when(F.col("kind") == z, F.col("trained")).otherwise(0)).alias(f"t{z}") for z in range(kinds)]
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"), *by)


def learn(words: DataFrame, kinds: int, rounds: int = ROUNDS, name: str = VOCABULARY) -> list[Lattice]:
    """Expectation-maximisation over each class's distinct training words; the driver sees one row a piece and class."""
    lattices, types = [vocabulary(name)] * max(1, kinds), words.where("trained > 0").select("word", *[f"t{z}" for z in range(kinds)])
    size = len(lattices[0].pieces) + 1
    for _ in range(rounds if kinds else 0):
        now = lattices

        def run(batches: Iterator[pa.RecordBatch], now: list[Lattice] = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((kinds, size), np.int64)
            for batch in batches:
                for z in range(kinds):
                    own = batch.column("word").filter(pa.array(batch.column(f"t{z}").to_numpy() > 0))
                    total[z, -1] += len(own)
                    for _, w in _groups(own):
                        total[z, :-1] += now[z].expect(w)
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total.ravel()[own])], ["place", "uses"])

        got = types.mapInArrow(lean(run), "place long, uses long").groupBy("place").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.zeros(kinds * size, np.int64)
        total[got.column("place").to_numpy()] = got.column("uses").to_numpy()
        lattices = [x.learned(own[:-1], int(own[-1])) for x, own in zip(now, total.reshape(kinds, size), strict=True)]
    return lattices


@dataclass(frozen=True)
class Part:
    """What the training rows of a class (or all) add up to."""

    ends: int
    words: int  #: running words
    distinct: int  #: distinct words
    discount: float

    @property
    def tokens(self) -> int:
        return self.words + self.ends

    def log_words(self, c: np.ndarray, rest: np.ndarray, ends: bool) -> np.ndarray:
        """Natural-log probabilities of words of count c, given those that unseen words share; ``ends``: among tokens."""
        counted = np.maximum(c - self.discount, 0) + (self.discount * self.distinct + 0.5) * np.exp(rest)
        # Where a count is 0 the rest may be less than a double holds outside its logarithm.
        only = np.log(self.discount * self.distinct + 0.5) + rest
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log(counted), only) - np.log((self.tokens if ends else self.words) + 0.5)

    def log_end(self) -> float:
        return float(np.log(self.ends / (self.tokens + 0.5)))


@dataclass(frozen=True)
class Corpus:
    whole: Part
    parts: list[Part]  #: none without training rows

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the base probability of tokens of training count c."""
        n, v = self.whole.tokens, self.whole.distinct + (self.whole.ends > 0)
        return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def token(self, c: np.ndarray, by: np.ndarray, log: np.ndarray) -> np.ndarray:
        """log10 p(w|z), a column a class, from training counts, those by class and log lattice probabilities."""
        if not self.parts:
            return (log + np.log(0.5)) / np.log(10)
        top = log.max(1)
        shares = np.array([p.ends / self.whole.ends for p in self.parts])
        general = self.whole.log_words(c, np.log(np.exp(log - top[:, None]) @ shares) + top, ends=False)
        rest = np.logaddexp(general[:, None], log) + np.log(0.5)
        return np.stack([part.log_words(by[:, z], rest[:, z], ends=True) for z, part in enumerate(self.parts)], 1) / np.log(10)

    def ends(self) -> np.ndarray:
        """log10 of share(z) * p(end|z)."""
        if not self.parts:
            return np.log10([0.5])
        return np.array([np.log(p.ends / self.whole.ends) + p.log_end() for p in self.parts]) / np.log(10)


def corpus_of(words: DataFrame, docs: DataFrame, kinds: int) -> Corpus:
    names = ["trained", *[f"t{z}" for z in range(kinds)]]
    sums_ = [x for c in names for x in (F.sum(c), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))]
    got = words.agg(*sums_).first()
    ends = {r[0]: r[1] for r in docs.where("train").groupBy("kind").count().collect()}

    def part(k: int, n: int) -> Part:
        total, distinct, once, twice = (x or 0 for x in got[4 * k : 4 * k + 4])
        return Part(n, total, distinct, once / (once + 2 * twice) if once and twice else 0.5)

    return Corpus(part(0, sum(ends.values())), [part(z + 1, ends[z]) for z in range(kinds)])


def word_scores(words: DataFrame, lattices: list[Lattice], corpus: Corpus) -> DataFrame:
    """hash, known (seen in training), base and models (a log10 probability a class) and count n of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("word"))
            c, log = batch.column("trained").to_numpy(), np.zeros((batch.num_rows, len(lattices)))
            for rows, w in _groups(batch.column("word")):
                found = lattices[0]._pieces_of(w)
                for z, lattice in enumerate(lattices):
                    log[rows, z] = lattice.log_words(w, found)
            by = np.stack([batch.column(f"t{z}").to_numpy() for z in range(len(corpus.parts))], 1) if corpus.parts else np.zeros((len(c), 0))
            models = corpus.token(c, by, log)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * models.shape[1], pa.int32()), pa.array(models.ravel()))
            h = np.concatenate([range_hashes(data[offs[a] : offs[b]], offs[a:b] - offs[a], offs[a + 1 : b + 1] - offs[a]) for a, b in _byte_ranges(offs)]) if len(c) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c > 0), pa.array(corpus.base(c)), lists, batch.column("n")], ["hash", "known", "base", "models", "n"])

    return words.mapInArrow(lean(run), "hash long, known boolean, base double, models array<double>, n long")


def _byte_ranges(offs: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


# ---- scores -------------------------------------------------------------------------------------


def _frequent(scored: DataFrame, most: int) -> tuple[int, dict[str, np.ndarray]]:
    """The least count of the commonest words, at most ``most`` of them, and these words' scores."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r[0], r[1]) for r in scored.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, cut = 0, None
    for k, n in levels:
        if total + n > most:
            break
        total, cut = total + n, k
    rows = scored.where(level >= cut if cut is not None else F.lit(False)).drop("n").toArrow()
    got = {c: rows.column(c).to_numpy() for c in ("hash", "known", "base")}
    got["models"] = rows.column("models").combine_chunks().flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    return cut if cut is not None else 1 << 30, got


def with_kinds(docs: DataFrame, column: str | None) -> tuple[DataFrame, int]:
    """doc_id, train, text and kind, the number of the row's class (-1: none); and the count of classes.

    Every value of the column in training rows is a class; the driver sees one row a class.
    """
    value = F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n")) if column else F.lit("n")
    docs = docs.select("doc_id", "train", text_or_empty().alias("text"), value.alias("kind"))
    found = sorted(r[0] for r in docs.where("train").select("kind").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, found)), F.col("kind")) - 1 if found else F.lit(-1)
    return docs.withColumn("kind", number.cast("int")), len(found)


def score(docs: DataFrame, class_column: str | None = None, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row; ``docs`` has ``train``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs, kinds = with_kinds(docs, class_column)
    words = durable(count_words(docs, kinds), "lm-words")
    corpus = corpus_of(words, docs, kinds)
    scored = durable(word_scores(words, learn(words, kinds, rounds), corpus), "lm-scores")
    width = max(1, kinds)
    cut, common = _frequent(scored, cells // width)
    hashes, known, base, models = common["hash"].view(np.uint64), common["known"].astype(bool), common["base"], common["models"]
    end_base, ends = float(corpus.base(np.array([corpus.whole.ends]))[0]), corpus.ends()
    end_known = corpus.whole.ends > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(hashes)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                data, n = LOWER[data], hi - lo
                start, end, first = spans(data, offs)
                h = range_hashes(data, start, end)
                at = keys.find(h) if len(hashes) else np.full(len(h), -1)
                hit = at >= 0
                of = np.repeat(np.arange(n), np.diff(first))
                take, by = at[hit], of[hit]
                rest = pa.array(h[~hit].view(np.int64))
                k = len(rest)
                total = np.stack([np.bincount(by, models[take, z], n) + ends[z] for z in range(width)], 1) if len(take) else np.tile(ends, (n, 1))
                ids, nothing = batch.column("doc_id").slice(lo, n), pa.nulls(k, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row + np.arange(n), row + of[~hit]])),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), rest]),
                        pa.concat_arrays([ids, pa.nulls(k, ids.type)]),
                        pa.concat_arrays([batch.column("train").slice(lo, n), pa.nulls(k, pa.bool_())]),
                        pa.concat_arrays([pa.array(np.diff(first) + 1), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([pa.array(np.bincount(by, known[take], n).astype(np.int64) + end_known), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([pa.array(np.bincount(by, base[take], n) + end_base), nothing]),
                        pa.concat_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(total.ravel())), pa.nulls(k, pa.list_(pa.float64()))]),
                    ],
                    ["row", "hash", "doc_id", "train", "n_tokens", "n_known", "base_score", "models"],
                )
                row += n

    # Written once: row numbers must not change between the two readings below.
    parts = durable(docs.mapInArrow(lean(run), f"row long, hash long, doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, models array<double>"), "lm-parts")
    level = F.floor(F.log2("n") * 16).cast("int")
    rare = parts.where("hash is not null").select("row", "hash").join(scored.where(level < cut).drop("n"), "hash")
    rare = rare.groupBy("row").agg(F.count_if("known").alias("more_known"), F.sum("base").alias("more_base"), F.array(*[F.sum(F.get("models", F.lit(z))) for z in range(width)]).alias("more"))
    out = parts.where("hash is null").drop("hash").join(rare, "row", "left")
    each = F.when(F.col("more").isNull(), F.col("models")).otherwise(F.zip_with("models", "more", lambda a, b: a + b))
    out = out.withColumn("models", each).withColumn("top", F.array_max("models"))
    marginal = F.col("top") + F.log10(F.aggregate("models", F.lit(0.0), lambda total, x: total + F.pow(F.lit(10.0), x - F.col("top"))))
    return out.select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(corpus.whole.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), marginal.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", fold_of("doc_id", 10) != 0)
    return score(docs, "lang").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
