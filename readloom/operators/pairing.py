"""Two files read by read: positional pairing and the check of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.reads import read_id


def zipped(first: DataFrame, second: DataFrame, how: str = "full_outer", key: str = "record_index") -> DataFrame:
    """Rows of both files by position: ``r1`` and ``r2`` structs, null where a side has ended.

    ``how="inner"`` stops at the shorter file.
    """
    a = first.select(key, F.struct(*[c for c in first.columns if c != key]).alias("r1"))
    b = second.select(key, F.struct(*[c for c in second.columns if c != key]).alias("r2"))
    return a.join(b, key, how)


def by_position(reads: DataFrame, first: str, second: str, key: str = "record_index") -> DataFrame:
    """The same pairs, outer, from one table of both files' records (column ``file``): one scan and one exchange."""
    columns = [c for c in reads.columns if c not in ("file", key)]
    of = lambda name: F.max(F.when(F.col("file") == name, F.struct(*columns)))
    return reads.where(F.col("file").isin(first, second)).groupBy(key).agg(of(first).alias("r1"), of(second).alias("r2"))


def name_check(pairs: DataFrame, key: str = "record_index") -> DataFrame:
    """Whole pairs with both read ids and whether they differ."""
    both = pairs.where(F.col("r1").isNotNull() & F.col("r2").isNotNull())
    return both.select(key, read_id(F.col("r1.header")).alias("id1"), read_id(F.col("r2.header")).alias("id2")).withColumn("differs", F.col("id1") != F.col("id2"))


def counters(pairs: DataFrame) -> DataFrame:
    """pairs_checked, name_mismatches, unpaired_reads and errors."""
    whole = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    differs = whole & (read_id(F.col("r1.header")) != read_id(F.col("r2.header")))
    got = pairs.agg(F.count_if(whole).alias("pairs_checked"), F.count_if(differs).alias("name_mismatches"), F.count_if(~whole).alias("unpaired_reads"))
    return got.withColumn("errors", F.col("name_mismatches") + F.col("unpaired_reads"))


def pair_errors(pairs: DataFrame, key: str = "record_index") -> DataFrame:
    """One row a mismatch or lone read, with a message."""
    whole = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    differs = whole & (read_id(F.col("r1.header")) != read_id(F.col("r2.header")))
    message = (
        F.when(differs, F.concat(F.lit("read names differ: '"), F.col("r1.header"), F.lit("' vs '"), F.col("r2.header"), F.lit("'")))
        .when(F.col("r2").isNull(), "read1 has extra records after read2 ended")
        .when(F.col("r1").isNull(), "read2 has extra records after read1 ended")
    )
    return pairs.select(key, message.alias("message")).where("message is not null")


def longer_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Counts of both files and which is longer: what an inner pairing leaves out."""
    n = first.agg(F.count("*").alias("n1")).crossJoin(second.agg(F.count("*").alias("n2")))  # one row by one row
    return n.withColumn("longer", F.when(F.col("n1") > F.col("n2"), "read1").when(F.col("n2") > F.col("n1"), "read2"))
