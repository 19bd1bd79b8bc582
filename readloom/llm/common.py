"""Helpers shared by the training-data operators: durable intermediates, table access and Arrow text buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = "file://" + tempfile.mkdtemp(prefix="readloom-")
    return _LOCAL_SHARED[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/readloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that are still to be read need it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/readloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and return the table read back.

    Lost executors then cost a reread of these files, never a recomputation of the plan behind them.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


def hex_double(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---- Python workers -------------------------------------------------------------------------------


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that gives freed memory back: idle workers live on beside those of the next stage."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


# ---- Arrow text buffers -------------------------------------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets into them; null rows count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offs[0] : offs[-1]]
    return data, offs - offs[0]


def text_chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (a longer text stands alone): first row, end row, bytes, offsets."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


# ---- word spans and hashes ----------------------------------------------------------------------

#: white space of the word pattern [^\x20\x09-\x0D]+
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, offs: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not in ``outside``, and each row's first run (n+1 values)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~outside[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:n]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand.

    Every eight bytes are mixed twice, with their place in the range, before they are summed: no pattern of the bytes
    can cancel, as it can in a polynomial modulo a power of two. ``seed`` gives hashes that stay in one process.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    salt = np.uint64(seed) + _ODD
    total = mix64(mix64((eights[starts] & _KEEP[np.minimum(size, 8)]) ^ salt) + _ODD)
    long_ = np.flatnonzero(size > 8)
    if len(long_):
        more = (size[long_] - 1) >> 3
        first = np.cumsum(more) - more
        step = 1 << 20  # ranges are taken in groups, so that one long text needs no more than its own bytes again
        lo = 0
        while lo < len(long_):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step)))
            own, n = long_[lo:hi], more[lo:hi]
            k = np.arange(int(n.sum())) - np.repeat(first[lo:hi] - first[lo], n) + 1
            at = np.repeat(starts[own], n) + 8 * k
            block = eights[at] & _KEEP[np.minimum(np.repeat(ends[own], n) - at, 8)]
            block = np.cumsum(mix64(mix64(block ^ salt) + _ODD * (k + 1).astype(np.uint64)))
            upto = np.cumsum(n) - 1
            total[own] += np.diff(block[upto], prepend=np.uint64(0))
            lo = hi
    return mix64(total + size.astype(np.uint64))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups; ``first`` has n+1 bounds, groups may be empty."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
