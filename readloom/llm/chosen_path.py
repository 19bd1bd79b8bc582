"""Jaccard self-join of documents over word n-grams by the chosen-path method.

A document is the set of its runs of five words (a shorter text is one run of all its words). Documents with equal
sets form a class; classes are joined. Every class has ``COORDINATES`` min-hash values, which embed its set so that two
classes agree on a coordinate with the probability of their Jaccard similarity.

A run splits the classes recursively: a node samples two coordinates by its path, and classes that share a value there
go down the same branch. With two samples a level a pair of similarity s survives a level with
q = 1 - (1 - s q)^2, which for s = 0.8 settles at q = 0.9375 however deep the tree gets; so ``runs_for(recall)``
independent runs reach any target recall (four give 0.99998). Buckets of at most ``SMALL`` classes are compared by
brute force. So are buckets that a split leaves nearly whole (their members really are alike, splitting cannot help);
larger ones are cut into blocks, a task compares two blocks, so neither one task nor the driver ever holds a group.

In a bucket, agreement of the sketches first picks the classes that may have a partner (``agreements_for`` and
``runs_for`` take half of the allowed failures each, so recall counts both); only their texts travel, and the exact
similarity of their sets decides. A pair counts in its first common bucket only, so partial counts add up and no list
of all pairs of a group is ever made: the result is one row a document.

Defined results: null texts count as empty; texts without words form one class (similarity 1 to each other, 0 to all
others); repeated rows are copies of one class and give one result row each; an empty table gives no rows. Extra
columns are ignored by :func:`join` and passed through by :func:`keep_first`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import durable, lean, mix64, range_hashes, spans, table, text_chunks, text_or_empty

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
COORDINATES = 128
SMALL = 512
#: shingles of a block at most, unless one document has more
BLOCK_SHINGLES = 400_000
DEEPEST = 12
#: a branch that keeps this share of its node, relative to the similarity, is dense
DENSE = 0.9

_RNG = np.random.default_rng(20180416)
_XOR = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_ODD = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_STEP = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Independent runs that find a pair of that similarity with that probability."""
    q = 1.0
    for _ in range(64):
        q = 1 - (1 - similarity * q) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def shingles(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    start, end, first = spans(data, offs)
    h = range_hashes(data, start, end)
    n = len(h)
    whole = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += h[k : n - WORDS + 1 + k] * _STEP[k]
    whole = mix64(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix64(np.array([(h[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minima of 32 bits for each set; all ones for an empty one."""
    out = np.full((len(sets), COORDINATES), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        for k in range(COORDINATES):
            out[some, k] = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], begin)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column("text")):
            sets = shingles(data, offs)
            minima = min_hashes(sets)
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(minima.ravel().view(np.int32)))
            short = [row.tobytes() for row in (minima & np.uint32(255)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array(short, pa.binary())], ["doc_id", "text_hash", "class", "n", "minima", "short"])


def sketches(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(lean(_sketch), f"doc_id {kind}, text_hash long, class binary, n int, minima array<int>, short binary")


# ---- splitting ----------------------------------------------------------------------------------


def _branches(node: Column, minima: Column) -> Column:
    """The two branches that a class takes at a node: sampled coordinates and the class's values there."""
    a = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES))
    b = F.pmod(a + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    return F.array(*[F.xxhash64(node, c, F.element_at(minima, (c + 1).cast("int"))) for c in (a, b)])


def buckets(classes: DataFrame, runs: int) -> DataFrame:
    """bucket, class, n, size and weight (shingles in the bucket) of every bucket of at least two classes.

    ``classes`` has class, n and minima; it may repeat a class.
    """
    # The first level: only branch names travel, not sketches.
    roots = F.flatten(F.array(*[_branches(F.lit(r).cast("long"), F.col("minima")) for r in range(runs)]))
    level = classes.where("n > 0").select("class", "n", F.explode(roots).alias("bucket")).groupBy("bucket", "class").agg(F.first("n").alias("n"))
    level = durable(level, "path-level")
    done, parent_size, sketch = [], None, None
    for depth in range(1, DEEPEST + 1):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), *([F.first("parent_size").alias("parent_size")] if depth > 1 else []))
        sizes = sizes.where("size > 1")
        dense = (F.col("size") >= DENSE * SIMILARITY * F.col("parent_size")) if depth > 1 else F.lit(False)
        # Written, so that the join's two sides are plain exchanges, whose hot buckets Spark can split.
        sizes = durable(sizes.withColumn("leaf", (F.col("size") <= SMALL) | dense | F.lit(depth == DEEPEST)), "path-sizes")
        placed = level.drop("parent_size").join(sizes.drop("parent_size"), "bucket")
        placed = durable(placed, "path-placed")
        done.append(placed.where("leaf").select("bucket", "class", "n", "size", "weight"))
        large = placed.where("not leaf").drop("leaf", "weight")
        if large.isEmpty():
            break
        if sketch is None:
            once = classes.groupBy("class").agg(F.first("minima").alias("minima"))
            large = large.join(once, "class")
            sketch = True
        level = large.select("class", "n", "minima", F.col("size").alias("parent_size"), F.explode(_branches(F.col("bucket"), F.col("minima"))).alias("bucket"))
        level = durable(level, "path-level")
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


# ---- buckets ------------------------------------------------------------------------------------


def _tasks(rows: DataFrame) -> DataFrame:
    """Deal bucket members to pairs of blocks: columns i <= j, and side (0: block i, 1: block j)."""
    blocks = F.greatest(F.ceil(F.col("size") / SMALL), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("blocks", F.least(blocks, F.col("size").cast("int"))).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("*", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).alias("side")).drop("blocks", "own", "other", "size", "weight")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Whole groups of rows of equal (bucket, i, j) from sorted batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
        cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            now = tuple(k[a].tolist())
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _not_earlier(group: pa.Table, bucket: int) -> np.ndarray:
    """Pairs of rows (matrix) that have no common bucket before this one."""
    n = group.num_rows
    lists = group.column("buckets").combine_chunks()
    flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(n), size)
    keep = flat < bucket
    value, row = flat[keep], row[keep]
    if not len(value):
        return np.ones((n, n), bool)
    _, back, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    names, back = np.unique(back[shared], return_inverse=True)
    if not len(names):
        return np.ones((n, n), bool)
    has = np.zeros((n, len(names)), np.float32)
    has[row[shared], back] = 1
    return (has @ has.T) == 0


def _wanted(group: pa.Table, i: int, j: int) -> np.ndarray:
    """Pairs that this task has to judge: across its two blocks, or inside its only one."""
    n = group.num_rows
    if i == j:
        return ~np.eye(n, dtype=bool)
    side = group.column("side").to_numpy().astype(bool)
    return side[:, None] != side[None, :]


def agreements_for(recall: float, similarity: float = SIMILARITY) -> int:
    """The most of COORDINATES sketch values that may be asked for, so that a pair of that similarity has them with that probability."""
    missed = 0.0
    for t in range(COORDINATES + 1):
        missed += math.comb(COORDINATES, t) * similarity**t * (1 - similarity) ** (COORDINATES - t)
        if missed > 1 - recall:
            return t
    return COORDINATES


def _candidates(least_agree: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that may have a partner whom they meet in no earlier bucket."""
    for (bucket, i, j), group in _grouped(batches):
        n = group.num_rows
        short = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(n, COORDINATES)
        maybe = np.zeros((n, n), bool)
        for lo in range(0, n, 64):
            maybe[lo : lo + 64] = (short[lo : lo + 64, None, :] == short[None]).sum(2) >= least_agree
        maybe &= _wanted(group, i, j)
        if maybe.any():
            maybe &= _not_earlier(group, bucket)
            some = maybe.any(1)
            if some.any():
                yield from group.filter(pa.array(some)).drop_columns(["short"]).combine_chunks().to_batches()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class with partners in a task: documents of its partners, and the least class of its component there."""
    for (bucket, i, j), group in _grouped(batches):
        # A text may come twice where rows repeat.
        names = group.column("class").to_pylist()
        group = group.take(pa.array(sorted({c: k for k, c in enumerate(names)}.values())))
        n = group.num_rows
        if n < 2:
            continue
        sets = []
        text = group.column("text").combine_chunks()
        for _, _, data, offs in text_chunks(text):
            sets += shingles(data, offs)
        size = np.array([len(s) for s in sets])
        if n == 2:
            both = np.zeros((2, 2))
            both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        else:
            value, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), size)
            shared = count[back] > 1
            row, back = row[shared], np.unique(back[shared], return_inverse=True)[1]
            order = np.argsort(back, kind="stable")
            row, back = row[order], back[order]
            both = np.zeros((n, n))
            width = max(1, 4_000_000 // n)
            for lo in range(0, int(back[-1]) + 1 if len(back) else 0, width):
                a, b = np.searchsorted(back, [lo, lo + width])
                has = np.zeros((n, width), np.float32)
                has[row[a:b], back[a:b] - lo] = 1
                both += has @ has.T
        linked = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
        linked &= _wanted(group, i, j)
        if linked.any():
            linked &= _not_earlier(group, bucket)
        if not linked.any():
            continue
        copies = group.column("copies").to_numpy().astype(np.int64)
        links = linked @ copies
        names = group.column("class").to_pylist()
        rank = np.argsort(np.argsort(np.array(names, dtype=object)))
        label = rank.copy()
        while True:  # least rank over partners until nothing changes
            new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
            new = new[np.argsort(rank)[new]]
            if (new == label).all():
                break
            label = new
        by_rank = np.argsort(rank)
        some = np.flatnonzero(linked.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.binary()), pa.array(links[some]), pa.array([names[by_rank[label[k]]] for k in some], pa.binary())], ["class", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """class and the least class of its component, from edges (class, root): hook to the least neighbour, then jump."""
    both = edges.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b"))
    both = durable(both.union(both.select("b", "a")).distinct(), "cc-edges")
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        # Written, so that the next join's sides are plain exchanges: Spark can then split the label of a large component.
        hooked = durable(labels.join(near, labels["class"] == near["a"]).select("class", F.col("label").alias("old"), F.least("label", "m").alias("label")), "cc-hooked")
        up = hooked.select(F.col("class").alias("label"), F.col("label").alias("up"))
        jumped = durable(hooked.join(up, "label", "left").select("class", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "cc-labels")
        labels = jumped.select("class", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, copy_id, n_links, n_copies of every row.

    class_id: the least doc_id of the documents that links connect; copy_id: that of the documents with an equal set;
    n_links: other documents of similarity 0.8 or more; n_copies: documents with an equal set, itself included.
    """
    # Runs and sketch filter may miss half of the failures each.
    share = (1 + recall) / 2
    rows = durable(sketches(docs), "cpj-sketches")
    classes = durable(rows.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies")), "cpj-classes")
    members = durable(buckets(rows.select("class", "n", "minima"), runs_for(share)), "cpj-buckets")
    lists = members.groupBy("class").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    short = rows.groupBy("class").agg(F.first("short").alias("short"))
    dealt = _tasks(members.join(lists.join(short, "class"), "class"))
    kept = "bucket long, class binary, n int, buckets array<long>, i int, j int, side boolean"
    sorted_ = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    order = ["bucket", "class", "n", "buckets", "i", "j", "side"]
    chosen = durable(sorted_(dealt.select(*order, "short")).mapInArrow(lean(partial(_candidates, agreements_for(share))), kept), "cpj-candidates")
    wanted = chosen.select("class").distinct().join(classes, "class").select("class", "copies", "first.doc_id", "first.text_hash")
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(text_or_empty()).alias("__hash"), text_or_empty().alias("text"))
    texts = texts.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash"))).select("class", "copies", "text")
    judged = durable(sorted_(chosen.drop("n").join(texts, "class")).mapInArrow(lean(_exact), "class binary, links long, root binary"), "cpj-links")
    labels = components(judged.select("class", "root"))
    links = judged.groupBy("class").agg(F.sum("links").alias("links"))
    # Both sides of the join by label are written, for the same reason as in components().
    found = durable(classes.join(links, "class", "left").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "cpj-found")
    least = durable(found.groupBy("label").agg(F.min("first").alias("least")), "cpj-least")
    found = found.join(least, "label").select("class", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), "least")
    out = rows.select("doc_id", "text_hash", "class").join(found, "class")
    return out.select("doc_id", "text_hash", F.col("least.doc_id").alias("class_id"), F.col("first.doc_id").alias("copy_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), (F.struct("doc_id", "text_hash") == F.col("least")).alias("first_of_class"))


def keep_first(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row of each class of linked documents, the one of the least doc_id, with all columns."""
    kept = join(docs, recall).where("first_of_class").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__h", F.xxhash64(text_or_empty()))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    # Rows that repeat as a whole are copies too.
    once = Window.partitionBy("doc_id", "__h").orderBy(F.lit(0))
    return rows.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)
