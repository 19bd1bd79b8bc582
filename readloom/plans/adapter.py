"""Synthetic read pairs made from the orders table, by SQL that Spark and DuckDB both run.

Every third key shares a template, so exact duplicates exist; the second read is cut from the template's other end, so
overlaps exist; some headers, bases, qualities and mates are spoilt, so checks find something. ``PAIRS`` reads a
relation ``orders`` and gives k, header1, seq1, qual1, header2, seq2, qual2 (the last three null for lone reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(key: str, salt: str, alphabet: str) -> str:
    return "concat(" + ", ".join(f"translate(md5(concat(cast({key} AS string), '{salt}{i}')), '0123456789abcdef', '{alphabet}')" for i in range(10)) + ")"


_BASES, _QUALITIES = "ACGTACGTACGTACGN", "#,5:?ADFHIFFFFFF"

PAIRS = f"""
SELECT k,
  CASE WHEN k % 97 = 0 THEN concat('#', name1) ELSE concat('@', name1) END AS header1,
  CASE WHEN k % 103 = 0 THEN concat(lower(substr(s1, 1, 1)), substr(s1, 2)) ELSE s1 END AS seq1,
  CASE WHEN k % 101 = 0 THEN substr(q1, 1, size - 1) ELSE substr(q1, 1, size) END AS qual1,
  CASE WHEN k % 89 = 0 THEN NULL WHEN k % 83 = 0 THEN concat('@other', cast(k AS string)) ELSE concat('@', name2) END AS header2,
  CASE WHEN k % 89 = 0 THEN NULL ELSE s2 END AS seq2,
  CASE WHEN k % 89 = 0 THEN NULL ELSE substr(q2, 1, length(s2)) END AS qual2
FROM (
  SELECT k, size, q1, q2, substr(template, 1, size) AS s1,
    reverse(translate(substr(template, greatest(1, span - size + 1), size), 'ACGT', 'TGCA')) AS s2,
    CASE WHEN k % 4 <> 0 THEN concat('A00459:371:HXY:1:1101:1000:', cast(k AS string), ' 1:N:0:ACGT') ELSE concat('E250122340L1C001R', cast(k AS string), '/1') END AS name1,
    CASE WHEN k % 4 <> 0 THEN concat('A00459:371:HXY:1:1101:1000:', cast(k AS string), ' 2:N:0:ACGT') ELSE concat('E250122340L1C001R', cast(k AS string), '/2') END AS name2
  FROM (
    SELECT k, 100 + t % 51 AS size, 60 + t % 250 AS span, {_text("t", "s", _BASES)} AS template, {_text("k", "q", _QUALITIES)} AS q1, {_text("k", "p", _QUALITIES)} AS q2
    FROM (SELECT o_orderkey AS k, o_orderkey - o_orderkey % 3 AS t FROM orders) a
  ) b
) c
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived at each use; from the table that the session setting ``readloom.pairs`` names, where it is set."""
    kept = spark.conf.get("readloom.pairs", None)
    if kept:
        return spark.read.parquet(kept)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(PAIRS.replace("FROM orders", "FROM {orders}"), orders=orders)


def side(pairs_: DataFrame, n: int) -> DataFrame:
    """One file's records: file, record_index, line, header, seq, plus, qual, n_lines."""
    rows = pairs_.where(F.col(f"seq{n}").isNotNull())
    return rows.select(
        F.lit(f"R{n}").alias("file"), F.col("k").alias("record_index"), (F.col("k") * 4 + 1).alias("line"),
        F.col(f"header{n}").alias("header"), F.col(f"seq{n}").alias("seq"), F.lit("+").alias("plus"), F.col(f"qual{n}").alias("qual"), F.lit(4).alias("n_lines"),
    )


def both(pairs_: DataFrame) -> DataFrame:
    """Both files' records from one scan of the pairs."""
    at = lambda n: F.struct(*[c.alias(x) for c, x in zip([F.lit(f"R{n}"), F.col(f"header{n}"), F.col(f"seq{n}"), F.col(f"qual{n}")], ["file", "header", "seq", "qual"], strict=True)])
    rows = pairs_.select("k", F.explode(F.array(at(1), at(2))).alias("r")).where("r.seq IS NOT NULL")
    return rows.select("r.file", F.col("k").alias("record_index"), (F.col("k") * 4 + 1).alias("line"), "r.header", "r.seq", F.lit("+").alias("plus"), "r.qual", F.lit(4).alias("n_lines"))


def reads(spark: SparkSession, sf_dir: str, n: int = 1) -> DataFrame:
    return side(pairs(spark, sf_dir), n)
