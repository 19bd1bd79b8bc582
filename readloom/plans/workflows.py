"""Whole runs: from input files to reports, manifests and scripts. Each returns the rows or texts it has written."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import texts as tf
from readloom.operators import duplicates, inserts, manifest, pairing, qc, validate
from readloom.plans import report
from readloom.sources import payloads
from readloom.sources.fastq import read_fastq


def _put(path: str, text: str, executable: bool = False) -> str:
    with open(path, "w", encoding="utf-8", newline="\n") as handle:
        handle.write(text)
    if executable:
        os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return path


def _lines(rows: DataFrame) -> str:
    """A file's lines; manifests have a row a file of a record, not of a corpus."""
    return "".join(f"{r[0]}\n" for r in rows.collect())


def quality(
    spark: SparkSession, read1: str, read2: str | None = None, json_path: str | None = None, tsv_prefix: str | None = None, sample: str | None = None,
    percent: bool = False, decimals: int = 6, most_insert: int = inserts.MOST, phred64: bool = False, tsv_comma: bool = False, json_comma: bool = False,
) -> str:
    """The quality summary of a file or a pair of files: the text for people, and JSON and TSV files where asked for."""
    files = [read_fastq(spark, p, phred64).where("n_lines = 4").cache() for p in (read1, read2) if p]
    pairs = pairing.zipped(files[0], files[1], "inner").select(F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2")) if read2 else None
    hist = insert = None
    if pairs is not None:
        dup = duplicates.rate(pairs, "seq1", "seq2").first()
        hist = inserts.histogram(pairs, most_insert, dense=True).cache()
        insert = inserts.peak(hist, most_insert).first()
    else:
        dup = duplicates.rate(files[0], "seq").first()
    parts = []
    for f in files:
        parts.append((qc.summary(f, percent).first(), qc.curves(qc.per_cycle_counts(f)).collect(), qc.length_histogram(f).collect(), qc.quality_histogram(f).collect()))
    both = None
    if read2:
        union = files[0].select("seq", "qual").unionByName(files[1].select("seq", "qual"))
        both = (qc.summary(union, percent).first(), qc.curves(qc.per_cycle_counts(union)).collect(), qc.length_histogram(union).collect())
    text = ""
    for k, (s, curve, _, _) in enumerate(parts, 1):
        text += (f"\n>>>> Read {k} <<<<\n" if read2 else "") + report.summary_text(s, curve, decimals, percent)
    if both:
        text += "\n>>>> Combined <<<<\n" + report.summary_text(both[0], both[1], decimals, percent)
    text += report.duplication_text(dup, decimals, percent) + (report.insert_text(insert) if insert else "")
    if json_path:
        reads = {f"read{k}": report.read_json(s, lengths, curve, qualities, decimals, percent, json_comma) for k, (s, curve, lengths, qualities) in enumerate(parts, 1)}
        _put(json_path, report.document(reads, both[0] if both else None, dup, (insert, hist.collect()) if insert else None, decimals, percent, json_comma) + "\n")
    if tsv_prefix:
        name = sample or spark.range(1).select(tf.sample_name(F.lit(read1))).first()[0]
        rate = dup["dup_rate"] * (100.0 if percent else 1.0)
        labelled = [("_R1", parts[0]), ("_R2", parts[1]), ("_combined", both)] if both else [("", parts[0])]
        for label, p in labelled:
            _put(f"{tsv_prefix}{label}_summary.tsv", report.summary_tsv(name, p[0], rate, insert, decimals, tsv_comma))
            _put(f"{tsv_prefix}{label}_cycles.tsv", report.cycles_tsv(p[1]))
            _put(f"{tsv_prefix}{label}_lengths.tsv", report.lengths_tsv(p[2]))
            _put(f"{tsv_prefix}{label}_lengths_percent.tsv", report.lengths_tsv(p[2], p[0]["total_reads"], decimals, percent))
    for f in files:
        f.unpersist()
    return text


def check(spark: SparkSession, read1: str, read2: str | None = None, strict_bases: bool = False, detect_quality: bool = False, infer_platform: bool = False, sample: int = validate.SAMPLE, json_path: str | None = None) -> tuple[str, bool]:
    """The validation summary of a file or a pair, and whether no error was found; the JSON report where asked for."""
    files = [read_fastq(spark, p) for p in (read1, read2) if p]
    names = [f.select("file").first() for f in files]
    names = [n[0] if n else p for n, p in zip(names, (read1, read2), strict=False)]
    rows = files[0] if len(files) == 1 else files[0].unionByName(files[1])
    pairs = None
    if len(files) == 2:
        whole = [f.where("n_lines = 4").select("record_index", "header", "seq") for f in files]
        pairs = pairing.counters(pairing.zipped(*whole))
    stats = validate.file_report(rows, strict_bases, detect_quality, sample, names) if infer_platform else validate.file_stats(rows, strict_bases, detect_quality, names)
    out = validate.report(stats, None, pairs, names)
    got = out.select("*", F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json")).first()
    if json_path:
        _put(json_path, got["json"] + "\n")
    return report.check_text(got), not got["errors"]


def run_files(spark: SparkSession, xml: str, outdir: str, prefix: str) -> DataFrame:
    """A run's XML to its file table, checksum list and one script a tool; returns the flat table."""
    table = manifest.require_rows(manifest.flat_files(payloads.read_file_elements(spark, xml)), "file elements").cache()
    wanted = manifest.downloadable(table)
    head = "\t".join(table.columns)
    _put(f"{outdir}/{prefix}_infor.xls", head + "\n" + _lines(table.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in table.columns]))))
    _put(f"{outdir}/{prefix}_download_md5.txt", _lines(manifest.md5_lines(wanted)))
    for tool in tf.TOOLS:
        _put(f"{outdir}/{prefix}_download_{tool}.sh", "\n".join(manifest.script(wanted, tool, prefix)) + "\n" + _lines(manifest.commands(wanted, tool)), executable=True)
    return table


def archive_files(spark: SparkSession, checksums: str, root: str, project: str, outdir: str) -> dict[str, int]:
    """An archive's checksum list to checksum files and scripts, for all files and for reads; returns their counts."""
    entries = payloads.read_checksums(spark, checksums)
    name = F.lit(spark.range(1).select(tf.project_name(F.lit(project))).first()[0])
    entries = entries.select("md5", tf.path_after(F.col("path"), name).alias("path")).cache()
    counts = {}
    for label, rows in (("all_files", entries), ("fastq", manifest.fastq_only(entries))):
        counts[label] = rows.count()
        _put(f"{outdir}/{label}_md5.txt", _lines(manifest.path_md5_lines(rows)))
        for tool in ("aspera", "axel", "aria2c"):
            _put(f"{outdir}/run_download_{label}_using_{tool}.sh", _lines(manifest.archive_commands(rows, root, tool)), executable=True)
    return counts


def record_files(spark: SparkSession, payload: str, outdir: str, prefix: str) -> DataFrame:
    """A record's JSON to its manifest, checksum and URL lists and scripts; returns the usable files."""
    raw = spark.read.option("wholetext", True).text(payload)
    files = manifest.require_rows(manifest.usable(raw.select(F.explode(payloads.record_files(F.col("value"))).alias("f")).select("f.*")), "usable files").cache()
    for tool in ("axel", "wget", "aria2c"):
        _put(f"{outdir}/{prefix}_{tool}.sh", "#!/usr/bin/env bash\nset -euo pipefail\n\n" + _lines(manifest.record_commands(files, tool)))
    _put(f"{outdir}/{prefix}_md5.txt", _lines(manifest.record_md5_lines(files)))
    _put(f"{outdir}/{prefix}_urls.txt", _lines(files.select("url")))
    table = manifest.manifest(files)
    _put(f"{outdir}/{prefix}_manifest.tsv", "\t".join(table.columns) + "\n" + _lines(table.select(F.concat_ws("\t", *table.columns))))
    return files
