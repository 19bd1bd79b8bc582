"""SentencePiece encoding and decoding by batched Viterbi over the pieces of an existing model file.

The model gives pieces and scores; a text's best segmentation is the one of the highest sum of scores. Pieces never
cross from a word into the next one's mark, so texts are cut into words, a word (with the marks before it) is solved
once however often it stands in a batch, and words of one length advance together: at each place the hashes of all
substrings that end there probe the sorted piece keys, and the maxima over their starts give the back pointers. A word
is first cut wherever two neighbouring characters stand together in no piece, as no segmentation crosses such a place;
so text without spaces makes short words too. A run whose every pair of neighbours is part of a piece stays one word,
at a step for each of its characters.

Encoding is lossless. A space becomes the mark U+2581, a mark in front stands for the start of the text; characters
that no piece covers, and marks that stand in the text itself, become byte pieces. Decoding is the exact inverse.

Defined results: a null text encodes as null; an empty text has no pieces; repeated rows and words give equal pieces;
of segmentations with equal scores the one whose last piece is longest wins, from the end backwards; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readloom.llm.common import lean, mix64, table

MODEL = "piece_bpe_32k.model"
MARK = 0x2581
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: added to the lowest score for a character that no piece covers
UNKNOWN = -10.0


class Keys:
    """Sorted 64-bit keys, probed by arrays: numbers of present keys, -1 for others.

    A table of the leading bits says where the search begins; ranges hold a key or few, so some steps up are a search.
    """

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.numbers = np.append(order, -1).astype(np.int32)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[keys >> self.shift]
        below = np.flatnonzero(self.keys[at] < keys)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < keys[below]]
        return np.where(self.keys[at] == keys, self.numbers[at], -1)


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(h * _BASE + c.astype(np.uint64) + np.uint64(1))


def hash_points(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in points:
        h = _extend(h, np.array([c]))
    return h[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    bytes_: np.ndarray  #: id of each byte's piece
    longest: int

    def __post_init__(self) -> None:
        usable = [i for i, p in enumerate(self.pieces) if p and not (p[0] == "<" and p[-1] == ">" and len(p) > 1) and np.isfinite(self.scores[i])]
        # A piece must not run over a word's end: marks may only lead.
        usable = [i for i in usable if chr(MARK) not in self.pieces[i].lstrip(chr(MARK))]
        self.ids = np.array(usable, np.int32)
        self.table = Keys(np.array([hash_points(code_points(self.pieces[i])) for i in usable], np.uint64))
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        inside = sorted({p[k : k + 2] for i in usable for p in [self.pieces[i]] for k in range(len(p) - 1)})
        self.neighbours = Keys(np.array([hash_points(code_points(x)) for x in inside], np.uint64))
        self.unknown = float(self.scores[self.ids].min(initial=0.0)) + UNKNOWN
        self.raw = [p.replace(chr(MARK), " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in enumerate(self.bytes_.tolist()):
            self.raw[i] = bytes([b])


def load(path: str) -> Model:
    """Pieces and scores of a SentencePiece model file with byte pieces; longer pieces of scores of -1e9 and less are unusable."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    scores = np.array([m.get_score(i) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) else -np.inf for i in range(n)])
    barred = scores <= -1e9
    scores[barred] = -np.inf
    # A character of its own stays usable, below all others.
    scores[[i for i in np.flatnonzero(barred) if len(pieces[i]) == 1]] = scores[np.isfinite(scores)].min() - 1
    return Model(pieces, scores, np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32), 1)


_LOADED: dict[str, Model] = {}


def model_of(name: str) -> Model:
    """The model of a path or a public tokenizer's name, read once in each Python worker."""
    if name not in _LOADED:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _LOADED[name] = load(path)
    return _LOADED[name]


# ---- Viterbi ------------------------------------------------------------------------------------

#: a mark of the text itself, kept apart from spaces; beyond Unicode, so no piece has it
_OWN_MARK = 0x110000


def viterbi(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of equal-length words (code points, one row each): the pieces' ids by end place, 0-based
    starts by end place. An id of -1 is a character without a piece."""
    n, length = words.shape
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    piece, start = np.full((n, length), -1, np.int32), np.zeros((n, length), np.int32)
    hashes = np.zeros((n, length), np.uint64)  # of the substring from each start to the current end
    for end in range(1, length + 1):
        low = max(0, end - model.longest)
        hashes[:, low:end] = _extend(hashes[:, low:end], words[:, end - 1 : end])
        found = model.table.find(hashes[:, low:end].reshape(-1)).reshape(n, -1)
        ids = np.where(found >= 0, model.ids[found], -1)
        value = best[:, low:end] + np.where(found >= 0, model.scores[ids], -np.inf)
        single = value[:, -1]
        np.copyto(single, best[:, end - 1] + model.unknown, where=found[:, -1] < 0)
        at = value.argmax(1)
        rows = np.arange(n)
        best[:, end], piece[:, end - 1], start[:, end - 1] = value[rows, at], ids[rows, at], low + at
    return piece, start


def _trace(model: Model, words: np.ndarray, piece: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows' best segmentations, left to right and joined, and the count of each row."""
    n, length = words.shape
    on = np.zeros((n, length), bool)
    at, rows = np.full(n, length), np.arange(n)
    while len(rows):
        on[rows, at[rows] - 1] = True
        at[rows] = start[rows, at[rows] - 1]
        rows = rows[at[rows] > 0]
    row, end = np.nonzero(on)
    ids = piece[row, end]
    plain = ids >= 0
    if plain.all():
        return ids, on.sum(1)
    out, counts = [], np.bincount(row, minlength=n)
    for r, e, i in zip(row.tolist(), end.tolist(), ids.tolist(), strict=True):
        if i >= 0:
            out.append(i)
        else:
            c = int(words[r, e])
            raw = chr(MARK if c == _OWN_MARK else c).encode("utf-8", "surrogatepass")
            out.extend(model.bytes_[list(raw)].tolist())
            counts[r] += len(raw) - 1
    return np.array(out, np.int32), counts


def encode_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and the count of each text's."""
    parts = [code_points(t) for t in texts]
    sizes = np.array([len(p) + (len(p) > 0) for p in parts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(bounds[-1], np.uint32)
    for a, p in zip(bounds[:-1], parts, strict=True):
        if len(p):
            flat[a] = 0x20
            flat[a + 1 : a + 1 + len(p)] = p
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    flat[flat == MARK] = _OWN_MARK
    flat[flat == 0x20] = MARK
    mark = flat == MARK
    begins = np.zeros(len(flat), bool)
    begins[bounds[:-1][sizes > 0]] = True
    begins[1:] |= mark[1:] & ~mark[:-1]
    begins[1:] |= model.neighbours.find(_extend(_extend(np.zeros(len(flat) - 1, np.uint64), flat[:-1]), flat[1:])) < 0
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(flat)))
    # Words of one length are made unique by their code points' hash, then solved together.
    counts = np.zeros(len(first), np.int64)
    where = np.zeros(len(first), np.int64)
    pool, used = [], 0
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        h = np.zeros(len(own), np.uint64)
        for k in range(length):
            h = _extend(h, flat[first[own] + k])
        _, rep, back = np.unique(h, return_index=True, return_inverse=True)
        ids, n = [], []
        for lo in range(0, len(rep), max(1, 200_000 // int(length))):
            at = first[own[rep[lo : lo + max(1, 200_000 // int(length))]]]
            words = flat[at[:, None] + np.arange(length)]
            i, c = _trace(model, words, *viterbi(model, words))
            ids.append(i)
            n.append(c)
        n = np.concatenate(n)
        begin = used + np.cumsum(n) - n
        counts[own], where[own] = n[back], begin[back]
        pool.append(np.concatenate(ids))
        used += len(pool[-1])
    pool = np.concatenate(pool)
    end = np.cumsum(counts)
    ids = pool[np.repeat(where - (end - counts), counts) + np.arange(end[-1])]
    cut = np.searchsorted(first, bounds)
    total = np.concatenate([[0], end])
    return ids, np.diff(total[cut])


def decode_ids(model: Model, ids: np.ndarray) -> str:
    """The text of a sequence of ids."""
    return b"".join(map(model.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _encoded(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model_of(name)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in _chunks(texts):
            ids, counts = encode_texts(model, [t or "" for t in texts[lo:hi]])
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts[lo:hi]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id and ids (null for a null text) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(partial(_encoded, name)), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ids; the inverse of :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(name)
        for batch in batches:
            ids = batch.column("ids")
            texts = [decode_ids(model, x.values.to_numpy()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")


def digests(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), and sha256 and length of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(name)
        for batch in batches:
            rows = []
            for x in batch.column("ids"):
                if not x.is_valid:
                    rows.append((None,) * 4)
                    continue
                ids = x.values.to_numpy()
                text = decode_ids(model, ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "decoded_chars"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, decoded_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, and sha256 and length of the text decoded from the ids, of every document in the order it comes, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(MODEL)
        for batch in _encoded(MODEL, batches):
            lists = batch.column("ids")
            texts = [decode_ids(model, x.values.to_numpy()) if x.is_valid else None for x in lists]
            sha = [t if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            chars = [t if t is None else len(t) for t in texts]
            counts = [len(x.values) if x.is_valid else None for x in lists]
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(chars, pa.int64())], ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "decoded_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, ids array<int>, n_pieces long, ids_crc32 long, decoded_sha256 string, decoded_chars long")
