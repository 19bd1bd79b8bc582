"""Four-line read files as DataFrames.

:func:`read_fastq` uses Spark's own text reader, so files split and decompress as Spark can. Lines are numbered inside
each file split and split offsets follow from their counts, so framing holds whatever the split size; no line's look
decides where a record starts. :class:`FastqSource` reads a file in one task and covers what the text reader can't:
gzip known by its first bytes only, and damaged files, whose error becomes a row.
"""

from __future__ import annotations

import gzip
import os
import zlib
from collections.abc import Iterator
from glob import glob

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.functions.reads import phred64_to_33

SCHEMA = "file string, record_index long, line long, header string, seq string, plus string, qual string, n_lines int"


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, ln (0-based line number in its file) and value (without one trailing carriage return)."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # One row a file split: Spark broadcasts it while it is small and joins by key beyond that.
    lines = raw.join(splits, ["file", "block"])
    return lines.select("file", (F.col("at") + F.col("shift")).alias("ln"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def framed(lines: DataFrame) -> DataFrame:
    """Records of four lines; ``n_lines`` is below 4 in a truncated last one."""
    at = F.col("ln") % 4
    part = lambda i: F.max(F.when(at == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("ln") / 4).alias("r")).agg(part(0).alias("header"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"), F.count("*").cast("int").alias("n_lines"))
    return records.select("file", (F.col("r") + 1).alias("record_index"), (F.col("r") * 4 + 1).alias("line"), "header", "seq", "plus", "qual", "n_lines")


def read_fastq(spark: SparkSession, paths: str | list[str], phred64: bool = False) -> DataFrame:
    """file, record_index, line, header, seq, plus, qual, n_lines of all records, truncated ones included."""
    for p in [paths] if isinstance(paths, str) else paths:
        if "://" not in p and not glob(p):
            raise FileNotFoundError(p)
    out = framed(numbered_lines(spark, paths))
    return out.withColumn("qual", phred64_to_33(F.col("qual"))) if phred64 else out


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.files = sorted(glob(os.path.join(path, "*")) if os.path.isdir(path) else glob(path))
        if not self.files:
            raise FileNotFoundError(path)

    def partitions(self) -> list[InputPartition]:
        return [_Part(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        with open(path, "rb") as probe:
            zipped = probe.read(2) == b"\x1f\x8b"
        index, held, error = 0, [], None
        with gzip.open(path, "rb") if zipped else open(path, "rb") as handle:
            while True:
                try:
                    raw = handle.readline()
                except (OSError, EOFError, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    break
                if not raw:
                    break
                text = raw.removesuffix(b"\n")
                held.append((text.removesuffix(b"\r") if raw.endswith(b"\n") else text).decode("utf-8", "replace"))
                if len(held) == 4:
                    yield (path, index + 1, index * 4 + 1, *held, 4, None)
                    index, held = index + 1, []
        if held or error:
            yield (path, index + 1, index * 4 + 1, *held, *[None] * (4 - len(held)), len(held), error)


class FastqSource(DataSource):
    """``spark.dataSource.register(FastqSource)``, then ``spark.read.format("fastq").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA + ", error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
