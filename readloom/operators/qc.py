"""Quality aggregates over reads (columns seq, qual; one row a read).

Totals need no explosion: counts of characters in a text come from its length before and after they are taken out.
Per-position tables and the quality histogram come from Arrow batches: the bytes of all reads of a batch are counted by
(position, base code) or by value at once, so a task sends eight rows a position at most, whatever it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.reads import PHRED_OFFSET, Q20, Q30, Q40, count_at_least, count_of, letters_of

#: base codes by letter; any letter with the same low bits counts alike
CODES = {"A": 1, "T": 4, "C": 3, "G": 7, "N": 6}
GC = (3, 7)


def _nonempty(reads: DataFrame) -> DataFrame:
    # A quality beyond its sequence is out of contract and ignored; a missing one is null.
    return reads.where(F.length("seq") > 0).select("seq", F.expr("substr(qual, 1, length(seq))").alias("qual"))


def _rate(part: Column, whole: Column, percent: bool) -> Column:
    return F.coalesce((100.0 if percent else 1.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def totals(reads: DataFrame) -> DataFrame:
    """One row of sums, which add up over files and tasks."""
    r = _nonempty(reads)
    cycle20 = F.ascii(F.substring("qual", 20, 1))
    return r.agg(
        F.count("*").alias("total_reads"),
        F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("total_bases"),
        F.coalesce(F.max(F.length("seq")), F.lit(0)).cast("int").alias("total_cycles"),
        F.coalesce(F.sum(count_of(F.col("seq"), letters_of(GC))), F.lit(0)).cast("long").alias("gc_bases"),
        *[F.coalesce(F.sum(count_at_least(F.col("qual"), q)), F.lit(0)).cast("long").alias(name) for name, q in (("q20_bases", Q20), ("q30_bases", Q30), ("q40_bases", Q40))],
        F.count_if((F.length("seq") >= 20) & (cycle20 >= Q20)).alias("cycle20_bases"),
        F.count_if(F.length("seq") >= 20).alias("cycle20_reads"),
    )


def rates(sums: DataFrame, percent: bool = False) -> DataFrame:
    """The totals with mean length (whole) and rates."""
    n = F.col("total_bases")
    return sums.select(
        "total_reads", "total_bases", "total_cycles", F.coalesce(F.expr("try_divide(total_bases - total_bases % nullif(total_reads, 0), total_reads)"), F.lit(0)).cast("long").alias("mean_length"),
        "gc_bases", _rate(F.col("gc_bases"), n, percent).alias("gc_content"),
        *[c for q in ("q20", "q30", "q40") for c in (F.col(f"{q}_bases"), _rate(F.col(f"{q}_bases"), n, percent).alias(f"{q}_rate"))],
        "cycle20_bases", _rate(F.col("cycle20_bases"), F.col("cycle20_reads"), percent).alias("cycle20_rate"),
    )


def summary(reads: DataFrame, percent: bool = False) -> DataFrame:
    return rates(totals(reads), percent)


def combined(*files: DataFrame, percent: bool = False) -> DataFrame:
    """The summary of several files together."""
    sides = [f.select("seq", "qual") for f in files]
    return summary(reduce(DataFrame.unionByName, sides), percent)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, nulls as empty, and the bounds of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _count_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((4, 0), np.int64)  # n, n_q20, n_q30, sum_q by cycle * 8 + code
    for batch in batches:
        seq, at = _bytes(batch.column("seq"))
        qual, q_at = _bytes(batch.column("qual"))
        size, q_size = np.diff(at), np.diff(q_at)
        place = np.arange(len(seq)) - np.repeat(at[:-1], size)
        cell = place * 8 + (seq & 7)
        has = place < np.repeat(q_size, size)
        q = qual[(np.repeat(q_at[:-1], size) + place)[has]].astype(np.int64)
        width = int(size.max(initial=0)) * 8
        if width > total.shape[1]:
            total = np.pad(total, ((0, 0), (0, width - total.shape[1])))
        own = cell[has]
        total[0, :width] += np.bincount(cell, minlength=width)
        total[1, :width] += np.bincount(own[q >= Q20], minlength=width)
        total[2, :width] += np.bincount(own[q >= Q30], minlength=width)
        total[3, :width] += np.bincount(own, q - PHRED_OFFSET, width).astype(np.int64)
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(used // 8 + 1, pa.int32()), pa.array(used % 8, pa.int32()), *[pa.array(x[used]) for x in total]], ["cycle", "code", "n", "n_q20", "n_q30", "sum_q"])


def _count_qualities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(_bytes(batch.column("qual"))[0], minlength=256)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["qual_ascii", "n"])


def per_cycle_counts(reads: DataFrame) -> DataFrame:
    """cycle, code, n, n_q20, n_q30, sum_q: the base table that curves are made of."""
    names = ("n", "n_q20", "n_q30", "sum_q")
    parts = _nonempty(reads).mapInArrow(_count_cycles, "cycle int, code int, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy("cycle", "code").agg(*[F.sum(c).alias(c) for c in names])


def curves(counts: DataFrame) -> DataFrame:
    """Per cycle: mean quality, quality by base (the mean where a base is absent), and shares of bases and of GC."""
    of = lambda value, *codes: F.sum(F.when(F.col("code").isin(*codes), F.col(value)).otherwise(0))
    total = F.sum("n")
    mean = F.sum("sum_q") / total
    quality = [F.coalesce(of("sum_q", CODES[b]) / F.nullif(of("n", CODES[b]), F.lit(0)), mean).alias(f"{b}_qual") for b in "ATCG"]
    content = [(of("n", CODES[b]) / total).alias(f"{b}_content") for b in "ATCGN"]
    return counts.groupBy("cycle").agg(mean.alias("mean_qual"), *quality, *content, (of("n", *GC) / total).alias("GC_content"))


def sampled(curve: DataFrame, about: int = 25) -> DataFrame:
    """Every k-th cycle from the first, so that some 25 remain."""
    step = F.greatest(F.lit(1), F.floor(F.max("cycle").over(Window.partitionBy()) / about))
    return curve.select("cycle", "mean_qual", step.alias("step")).where((F.col("cycle") - 1) % F.col("step") == 0).drop("step")


def quality_histogram(reads: DataFrame) -> DataFrame:
    """qual_ascii and n over all bases."""
    parts = _nonempty(reads).select("qual").mapInArrow(_count_qualities, "qual_ascii int, n long")
    return parts.groupBy("qual_ascii").agg(F.sum("n").alias("n"))


def length_histogram(reads: DataFrame, column: str = "seq") -> DataFrame:
    """length, n and share of the rows with a non-empty text."""
    n = reads.where(F.length(column) > 0).groupBy(F.length(column).alias("length")).agg(F.count("*").alias("n"))
    # One row a length: the window sees the histogram, not the reads.
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def text_profile(rows: DataFrame, column: str) -> DataFrame:
    """position, code and n over all ASCII characters of any text column."""
    each = rows.select(F.posexplode(F.split(F.regexp_replace(column, "[^ -~]", ""), "")).alias("at", "c")).where("c <> ''")
    return each.groupBy((F.col("at") + 1).alias("cycle"), F.ascii("c").bitwiseAND(7).alias("code")).agg(F.count("*").alias("n"))
