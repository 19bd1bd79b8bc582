"""Running aggregates over a stream of reads (columns seq, qual and, for duplicates, a time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import qc


def running_totals(reads: DataFrame) -> DataFrame:
    """The quality totals so far; write in complete or update mode."""
    return qc.totals(reads)


def running_lengths(reads: DataFrame) -> DataFrame:
    return reads.where(F.length("seq") > 0).groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n"))


def first_sightings(reads: DataFrame, time: str, horizon: str = "1 hour") -> DataFrame:
    """Each sequence once within the horizon; the state of older ones is dropped by the watermark."""
    return reads.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["seq"])
