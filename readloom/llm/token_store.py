"""Token ids on disk in Simple-8b blocks: 64-bit words whose four-bit selector says how many ids of what width follow.

The store is a folder of shards in ascending document order. A shard holds blocks of whole documents (about
``BLOCK_IDS`` ids; a longer document makes a longer block); a block carries its document ids, its offset in the
shard's id sequence and one self-contained payload:

    4 bytes ``S8B1``; u32 documents; u64 ids; u32 words; u32 escapes; u32 ids of each document; u64 words; u64 escapes

Selector 0 stands for one id of more than 60 bits: the word's payload is its index in the block's escape table, so a
word's place never depends on the value of another and a block is decoded by one gather for each selector.

Spark sorts documents by range, so shards need no more than their own neighbours; a shard's start is the sum of the
shards before it. Equal ids are ordered by text hash. Defined results: a null text counts as empty (its only id is the
end id); a null document id sorts first; repeated rows are stored each; an empty table gives an empty store. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import lean, range_hashes, shared_path, spans, sums, table, text_chunks, text_or_empty

BLOCK_IDS = 1 << 17
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

#: the Simple-8b layouts, fixed values: ids in a word and bits of each; the first is the escape
LAYOUTS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([n for n, _ in LAYOUTS])
_WIDTH = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int8)
_HEAD = struct.Struct("<4sIQII")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words and escapes of an unsigned id array; each word takes as many ids as fit."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if ids.max() < 1 << 16:
        width = _WIDTH[ids]
    else:
        ids, width = ids.astype(np.uint64), np.zeros(n, np.int8)
        for bits in range(int(ids.max()).bit_length()):
            width += ids >= np.uint64(1 << bits)
    width = np.append(width, np.zeros(120, np.int8))  # past the end a word may be filled up
    choice = np.zeros(n + 120, np.int8)
    own = np.arange(n + 120)
    for s in range(len(LAYOUTS) - 1, 0, -1):
        count, bits = LAYOUTS[s]
        own = own[width[own] <= bits]
        choice[own[: len(own) - count + 1][own[count - 1 :] - own[: len(own) - count + 1] == count - 1]] = s
    choice = choice[:n]
    step = np.arange(n) + _COUNT[choice]
    nxt, begin, i = step.tolist(), [], 0
    while i < n:
        begin.append(i)
        i = nxt[i]
    begin = np.array(begin)
    chosen = choice[begin]
    words, escapes = chosen.astype(np.uint64) << np.uint64(60), np.zeros(0, np.uint64)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(120, np.uint64)])
    for s in np.unique(chosen):
        count, bits = LAYOUTS[s]
        own = np.flatnonzero(chosen == s)
        if s == 0:
            escapes = padded[begin[own]]
            words[own] |= np.arange(len(own), dtype=np.uint64)
        elif bits:
            for k in range(count):
                words[own] |= padded[begin[own] + k] << np.uint64(k * bits)
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of Simple-8b words: one gather for each selector that occurs."""
    selector, body = (words >> np.uint64(60)).astype(np.int64), words & np.uint64((1 << 60) - 1)
    end = np.cumsum(_COUNT[selector])
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    for s in np.unique(selector):
        count, bits = LAYOUTS[s]
        own = np.flatnonzero(selector == s)
        at = end[own] - count
        if s == 0:
            out[at] = escapes[body[own].astype(np.int64)]
        elif bits:
            for k in range(count):
                out[at + k] = (body[own] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out[:n]


def to_block(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes = pack(ids)
    return b"".join([_HEAD.pack(b"S8B1", len(lengths), len(ids), len(words), len(escapes)), lengths.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def from_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each document (counts) and all ids of a block."""
    magic, docs, n, n_words, n_escapes = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b block")
    at = _HEAD.size
    lengths = np.frombuffer(payload, "<u4", docs, at)
    words = np.frombuffer(payload, "<u8", n_words, at + 4 * docs)
    escapes = np.frombuffer(payload, "<u8", n_escapes, at + 4 * docs + 8 * n_words)
    return lengths.astype(np.int64), unpack(words, escapes, n)


#: Latin letters whose case folds one to one, then marks that start no contraction
_SPLIT = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~][!-/:-@\\[-`{-~]*)?").fullmatch


class _Index:
    """Numbers by 64-bit key in an open table that takes further keys; found and put in by arrays."""

    def __init__(self, bits: int):
        self.mask, self.steps = (1 << bits) - 1, 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def insert(self, keys: np.ndarray, values: range) -> None:
        slot, left, number, step = (keys & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys)), np.array(values, np.int32), 1
        while len(left):
            free = left[self.values[slot[left]] < 0]
            own, one = np.unique(slot[free], return_index=True)
            self.keys[own], self.values[own] = keys[free[one]], number[free[one]]
            left = left[self.values[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & self.mask
            self.steps, step = max(self.steps, step), step + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        got = self.values[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & (got >= 0))
        for _ in range(self.steps - 1):
            slot[open_] = (slot[open_] + 1) & self.mask
            got[open_] = self.values[slot[open_]]
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (got[open_] >= 0)]
        got[open_] = -1
        return got


class WordTokenizer:
    """Encodes by distinct word: the tokenizer drops white space and never joins words over it.

    A run of Latin letters and the ASCII marks behind it are pieces of their own to the tokenizer, and it folds case,
    so ``Word,`` takes its ids from ``word`` and ``,``. Words are known by 64-bit hashes of their bytes, seeded anew in each
    worker, in a memory that is emptied at ``most`` words; neither changes a result.
    """

    #: a word of its own to the tokenizer, one id, that separates the words of one call
    MARK = "\x01"

    def __init__(self, path: str, most: int = 2_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.seed = Tokenizer.from_file(path), most, int.from_bytes(os.urandom(8)) >> 1
        self.tokenizer.no_truncation()
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self.tokenizer.encode(f"a {self.MARK} a", add_special_tokens=False).ids[1:2] == mark else None
        self.clear()

    def clear(self) -> None:
        self.place, self.n, self.used, self.index = {}, 0, 0, _Index(22)
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self._learn(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.place[""] = 0

    def _learn(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Store the ids of further words; their numbers."""
        n = len(sizes)
        while self.n + n > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.start[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + n, self.used + len(ids)
        return range(self.n - n, self.n)

    def _name(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(words, self._learn(ids, sizes), strict=True))

    def _encode(self, words: list[str]) -> None:
        apart = [w for w in words if self.mark is None or self.MARK in w]
        if apart:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)]
            self._name(apart, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found]))
            words = [w for w in words if self.mark is not None and self.MARK not in w]
        sep = f" {self.MARK} "
        for lo in range(0, len(words), 8192):
            part = words[lo : lo + 8192]
            for k, e in enumerate(self.tokenizer.encode_batch_fast([sep.join(part[i : i + 128]) for i in range(0, len(part), 128)], add_special_tokens=False)):
                ids, own = np.array(e.ids, np.uint32), part[128 * k : 128 * k + 128]
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                if len(ends) != len(own):  # a word that gives the mark's id by itself
                    for w in own:
                        alone = self.tokenizer.encode(w, add_special_tokens=False).ids
                        self._name([w], np.array(alone, np.uint32), np.array([len(alone)]))
                    continue
                self._name(own, ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)], size

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        """Learn words by their hashes, from the ids of their parts."""
        place, parts, alone = self.place, [], set()
        for w in words:
            m = _SPLIT(w)
            head, tail = (m[1].lower(), m[2] or "") if m else (w, "")
            if head not in place:
                alone.add(head)
            if tail not in place:
                alone.add(tail)
            parts += (head, tail)
        self._encode(list(alone))
        ids, sizes = self._gather(np.fromiter(map(place.__getitem__, parts), np.int64, len(parts)))
        self.index.insert(hashes, self._learn(ids, sizes.reshape(-1, 2).sum(1)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes and n+1 offsets) in order, and the count of each text's."""
        start, end, first = spans(data, offs)
        h = range_hashes(data, start, end, self.seed)
        at = self.index.find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, rep = np.unique(h[miss], return_index=True)
            if self.n + 2 * len(new) > self.most:
                self.clear()
                new, rep = np.unique(h, return_index=True)
                miss = np.arange(len(h))
            raw = data.tobytes()
            self._add(new, [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[miss[rep]].tolist(), end[miss[rep]].tolist(), strict=True)])
            at[miss] = self.index.find(h[miss])
        ids, sizes = self._gather(at)
        return ids, sums(sizes, first)


#: UTF-8 bytes and n+1 offsets of texts -> all their ids in order, the count of each
Encode = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
_ENCODERS: dict[str, WordTokenizer] = {}


def word_bpe(name: str = TOKENIZER) -> Encode:
    """An encoder for :func:`write_ids`, made once in each Python worker; ``name``: a public tokenizer or a path."""

    def encode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if name not in _ENCODERS:
            import public_tokenizers

            _ENCODERS[name] = WordTokenizer(name if os.path.isabs(name) else public_tokenizers.path(name))
        return _ENCODERS[name].encode(data, offs)

    return encode


def write_ids(docs: DataFrame, path: str, encode: Encode, end_id: int | None = END_ID) -> None:
    """Encode every text, append ``end_id`` and write the store in ascending doc_id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, before, ids, lengths, names, held = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, ids, lengths, names, held
            count = np.array(lengths)
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([names], pa.list_(type_)), pa.array([to_block(count, np.concatenate(ids))], pa.binary())]
            block, before, ids, lengths, names, held = block + 1, before + held, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["shard", "block", "before", "n_ids", "doc_ids", "payload"])

        type_ = None
        for batch in batches:
            type_ = batch.schema.field("doc_id").type
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                found, sizes = encode(data, offs)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                for k, name in enumerate(batch.column("doc_id").slice(lo, hi - lo).to_pylist()):
                    own = found[bounds[k] : bounds[k + 1]]
                    ids.append(own if end_id is None else np.append(own, np.uint32(end_id)))
                    lengths.append(len(ids[-1]))
                    names.append(name)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield flush()
        if lengths:
            yield flush()

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(lean(run), f"shard int, block int, before long, n_ids long, doc_ids array<{kind}>, payload binary").write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the count of ids before each in the whole store."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # One row a shard: as many as the write had tasks, whatever they hold.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("shard_start"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("before")).drop("shard_start")


def _documents(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, payload in zip(batch.column("start").to_pylist(), batch.column("doc_ids"), batch.column("payload"), strict=True):
                lengths, ids = from_block(payload.as_py())
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [names.values, pa.array(bounds[:-1] + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids of every document, decoded from the store."""
    blocks = read_blocks(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("start", "doc_ids", "payload").mapInArrow(lean(_documents(with_ids)), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_ids(table(spark, sf_dir, "documents"), path, word_bpe())
    return read_documents(spark, path, with_ids=False)
