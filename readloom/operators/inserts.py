"""Insert sizes of read pairs from their overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.reads import insert_size, overlap

MOST = 512


def sizes(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """The pairs (columns seq1, seq2 and others) with the overlap and insert_size."""
    found = pairs.withColumn("overlap", overlap(F.col("seq1"), F.col("seq2")))
    return found.withColumn("insert_size", insert_size(F.col("seq1"), F.col("seq2"), F.col("overlap"), most))


def histogram(pairs: DataFrame, most: int = MOST, dense: bool = False) -> DataFrame:
    """insert_size and n; ``dense`` lists every size from 0 to ``most``."""
    n = sizes(pairs, most).groupBy("insert_size").agg(F.count("*").alias("n"))
    if not dense:
        return n
    every = pairs.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("insert_size"))
    return every.join(n, "insert_size", "left").select("insert_size", F.coalesce("n", F.lit(0)).alias("n"))


def peak(hist: DataFrame, most: int = MOST) -> DataFrame:
    """peak (the commonest size below ``most``, the least of equals, 0 for none), unknown and pairs."""
    below = F.col("insert_size") < most
    top = F.max_by(F.when(below, F.col("insert_size")), F.when(below, F.struct(F.col("n"), -F.col("insert_size"))))
    return hist.agg(F.coalesce(top, F.lit(0)).alias("peak"), F.coalesce(F.sum(F.when(F.col("insert_size") == most, F.col("n"))), F.lit(0)).alias("unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
