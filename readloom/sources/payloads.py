"""Fetched archive payloads (XML, JSON, HTML, checksum lists, tables) as DataFrames. Fetching itself is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a run's file table, in order.
FILE_COLUMNS = ["run", "cluster", "filename", "size", "date", "md5", "version", "semantic_name", "supertype", "sratoolkit", "url", "free_egress", "access_type", "org"]

RECORD_SCHEMA = "files array<struct<key string, size bigint, checksum string, links struct<self string>>>"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header; all columns text, empty cells empty texts."""
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return raw.select(*[F.coalesce(raw[f"`{c}`"], F.lit("")).alias(c) for c in raw.columns])


def read_file_elements(spark: SparkSession, path: str) -> DataFrame:
    """The file elements of run XML: their attributes as text, and the array of their alternatives."""
    raw = spark.read.format("xml").option("rowTag", "SRAFile").option("inferSchema", False).load(path)
    return raw.select(*[F.col(f"`{c}`").alias(c.removeprefix("_")) for c in raw.columns])


def files_of_xml(xml: Column) -> Column:
    """A run element as text: its accession and file elements, each with attributes and alternatives, all text."""
    attrs = ["cluster", "filename", "url", "size", "date", "md5", "version", "semantic_name", "supertype", "sratoolkit"]
    other = ["url", "free_egress", "access_type", "org"]
    fields = ", ".join(f"_{a}: string" for a in attrs)
    inner = ", ".join(f"_{a}: string" for a in other)
    return F.from_xml(xml, f"_accession string, SRAFiles struct<SRAFile: array<struct<{fields}, Alternatives: array<struct<{inner}>>>>>")


def run_accessions(xml: Column) -> Column:
    """The accessions of run elements anywhere in an XML text."""
    return F.xpath(xml, F.lit("//RUN/@accession"))


def record_ids(xml: Column) -> Column:
    """The non-empty Id elements of a search result."""
    return F.filter(F.xpath(xml, F.lit("//Id/text()")), lambda i: i != "")


def record_files(payload: Column) -> Column:
    """The files of a record's JSON: name, url, size (0 where missing) and md5 (empty where missing)."""
    parsed = F.from_json(payload, RECORD_SCHEMA)
    return F.transform(
        parsed["files"],
        lambda f: F.struct(
            F.coalesce(f["key"], F.lit("")).alias("name"),
            F.coalesce(f["links"]["self"], F.lit("")).alias("url"),
            F.coalesce(f["size"], F.lit(0)).alias("size"),
            F.when(f["checksum"].startswith("md5:"), F.substring(f["checksum"], 5, 1 << 20)).otherwise("").alias("md5"),
        ),
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """md5 and path of each line of exactly two words."""
    return checksum_lines(spark.read.text(path))


def checksum_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    words = F.split(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""), r"\s+")
    return lines.select(words.alias("w")).where(F.size("w") == 2).select(F.col("w")[0].alias("md5"), F.col("w")[1].alias("path"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text each: file and html."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
