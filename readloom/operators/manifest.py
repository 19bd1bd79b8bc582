"""Archive manifests: file tables, filters, checksum lists and download scripts as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.texts import archive_download_command, download_command, file_name, human_size, record_download_command
from readloom.sources.payloads import FILE_COLUMNS


def flat_files(files: DataFrame) -> DataFrame:
    """Each file with each of its alternatives, or once where it has none; an alternative's value beats the file's.

    A file's own url never counts: without an alternative there is none. Missing cells are empty texts. Columns come
    in the fixed order, unknown ones behind it by name.
    """
    inner = next((f.dataType.elementType if f.dataType.typeName() == "array" else f.dataType for f in files.schema if f.name == "Alternatives"), None)
    names = {n.removeprefix("_"): n for n in (inner.names if inner is not None else [])}
    rows = files
    if inner is not None:
        many = files.schema["Alternatives"].dataType.typeName() == "array"
        rows = files.withColumn("__alt", F.explode_outer("Alternatives") if many else F.col("Alternatives")).drop("Alternatives")
    own = [c for c in rows.columns if c not in ("__alt", "url")]
    extra = sorted((set(own) | set(names)) - set(FILE_COLUMNS))

    def cell(c: str) -> Column:
        options = [F.col("__alt")[names[c]]] if c in names else []
        options += [F.col(f"`{c}`")] if c in own else []
        return F.coalesce(*[o.cast("string") for o in options], F.lit("")).alias(c)

    return rows.select(*[cell(c) for c in [*FILE_COLUMNS, *extra]])


def merged(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that a table lacks are empty texts there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.na.fill("")


def downloadable(files: DataFrame) -> DataFrame:
    """Rows for anonymous access with a URL."""
    return files.where((F.col("access_type") == "anonymous") & (F.coalesce("url", F.lit("")) != ""))


def usable(files: DataFrame) -> DataFrame:
    """Record files with a name and a URL."""
    return files.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def fastq_only(entries: DataFrame) -> DataFrame:
    return entries.where(F.endswith("path", F.lit("q.gz")))


def runs(accessions: DataFrame, column: str = "run") -> DataFrame:
    """The distinct run accessions in order."""
    return accessions.where(F.col(column).rlike("^[SED]RR")).select(column).distinct().orderBy(column)


def md5_lines(files: DataFrame, filename: str = "filename", md5: str = "md5", url: str = "url") -> DataFrame:
    """``md5  name`` of rows that have both; the name falls back to the URL's."""
    name = file_name(F.col(filename), F.col(url))
    return files.where((F.coalesce(md5, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")).select(F.concat_ws("  ", F.col(md5), name).alias("line"))


def path_md5_lines(entries: DataFrame) -> DataFrame:
    """``md5<tab>base name`` of archive entries."""
    return entries.select(F.concat_ws("\t", "md5", F.element_at(F.split("path", "/"), -1)).alias("line"))


def record_md5_lines(files: DataFrame) -> DataFrame:
    return files.where(F.coalesce("md5", F.lit("")) != "").select(F.concat_ws("  ", "md5", "name").alias("line"))


def manifest(files: DataFrame) -> DataFrame:
    """filename, size (for people), size_bytes, md5, url."""
    return files.select(F.col("name").alias("filename"), human_size(F.col("size")).alias("size"), F.col("size").alias("size_bytes"), "md5", "url")


def script(files: DataFrame, tool: str, prefix: str) -> list[str]:
    """The head of a download script; its body is :func:`commands`."""
    return ["#!/usr/bin/env bash", "set -euo pipefail", "", f"# Download anonymous links for {prefix}", "# Generated by readloom", ""]


def commands(files: DataFrame, tool: str) -> DataFrame:
    """line: a comment, a command and a blank line for each file that the tool can fetch, as one text."""
    command = download_command(tool, F.col("filename"), F.col("url"))
    note = F.concat(F.lit("# filename: "), F.col("filename"), F.lit("; semantic_name: "), F.col("semantic_name"))
    return files.select(F.concat_ws("\n", note, command, F.lit("")).alias("line"), command.alias("command")).where("command is not null").drop("command")


def record_commands(files: DataFrame, tool: str) -> DataFrame:
    note = F.concat(F.lit("# "), F.col("name"), F.lit(" ("), human_size(F.col("size")), F.lit(")"))
    return files.select(F.concat_ws("\n", note, record_download_command(tool, F.col("name"), F.col("url"))).alias("line"))


def archive_commands(entries: DataFrame, root: str, tool: str) -> DataFrame:
    return entries.select(archive_download_command(tool, F.lit(root), F.col("path")).alias("line"))


def entry_counts(entries: DataFrame) -> DataFrame:
    """How many entries there are, and how many are reads."""
    return entries.agg(F.count("*").alias("all_files"), F.count_if(F.endswith("path", F.lit("q.gz"))).alias("fastq"))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error where there are none."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows
