"""Duplicate reads: exact counts by key, and the flag of every later sighting.

Exact counting is two aggregations with map-side combining, so a sequence that makes up a third of the rows is one row
a task before the shuffle. ``approximate=True`` counts distinct keys by a sketch of fixed size instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(rows: DataFrame, *keys: str, approximate: bool = False) -> DataFrame:
    """total, duplicates (all but the first of each key) and dup_rate; empty keys count too."""
    if approximate:
        got = rows.agg(F.count("*").alias("total"), F.approx_count_distinct(F.struct(*keys), 0.01).alias("kinds"))
        got = got.select("total", F.greatest(F.lit(0), F.col("total") - F.col("kinds")).alias("duplicates"))
    else:
        got = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return got.withColumn("dup_rate", F.coalesce(F.col("duplicates") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def flags(rows: DataFrame, order: str | Column, *keys: str) -> DataFrame:
    """All rows with ``is_duplicate``: the key stands in an earlier row.

    The first place of each key is an aggregate joined back, so no task sorts all rows of a common key.
    """
    place = F.col(order) if isinstance(order, str) else order
    first = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(place).alias("__first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(first, same).withColumn("is_duplicate", place > F.col("__first")).drop("__first", *[f"__{k}" for k in keys])


def flags_in_order(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The same by a window, which also tells ties of ``order`` apart."""
    return rows.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1)
