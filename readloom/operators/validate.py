"""Record checks: an array of findings for each read, file statistics, encoding and platform, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.reads import PLATFORMS, phred_label

SAMPLE = 10_000
SURE = 0.8


def _length(c: str) -> Column:
    return F.octet_length(c)


def bad_quality_bytes(qual: Column) -> Column:
    """Quality bytes outside 33..126, each one an error."""
    return F.octet_length(F.regexp_replace(qual, "[!-~]", ""))


def _checks(strict_bases: bool) -> list[tuple[Column, str, Column]]:
    """Condition, code and message of each finding that a record can have once."""
    whole = F.col("n_lines") == 4
    missing = F.when(F.col("n_lines") == 1, "sequence").when(F.col("n_lines") == 2, "plus").otherwise("quality")
    checks = [
        (~whole, "truncated", F.concat(F.lit("truncated record: missing "), missing, F.lit(" line"))),
        (whole & ~F.startswith("header", F.lit("@")), "header", F.concat(F.lit("header must start with '@': "), F.col("header"))),
        (whole & (_length("seq") == 0), "empty", F.lit("sequence is empty")),
        (whole & ~F.startswith("plus", F.lit("+")), "plus", F.concat(F.lit("plus line must start with '+': "), F.col("plus"))),
        (whole & (_length("seq") != _length("qual")), "length", F.concat(F.lit("sequence/quality length mismatch: "), _length("seq").cast("string"), F.lit(" vs "), _length("qual").cast("string"))),
    ]
    if strict_bases:
        checks.append((whole & F.col("seq").rlike("[^ACGTN]"), "bases", F.lit("sequence contains bases outside A/C/G/T/N")))
    return checks


def findings(strict_bases: bool = False, detect_quality: bool = False) -> Column:
    """An array of (code, message) for the columns header, seq, plus, qual, n_lines of a record."""
    checks = [F.when(cond, F.struct(F.lit(code).alias("code"), message.alias("message"))) for cond, code, message in _checks(strict_bases)]
    out = F.filter(F.array(*checks), lambda x: x.isNotNull())
    if detect_quality:
        bytes_ = F.transform(F.regexp_extract_all(F.hex(F.col("qual").cast("binary")), F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10).cast("int"))
        message = lambda b: F.concat(F.lit("quality contains non-printable ASCII byte "), b.cast("string"))
        bad = F.transform(F.filter(bytes_, lambda b: (b < 33) | (b > 126)), lambda b: F.struct(F.lit("quality").alias("code"), message(b).alias("message")))
        # Bytes are listed only where one is bad.
        out = F.when((F.col("n_lines") == 4) & (bad_quality_bytes(F.col("qual")) > 0), F.concat(out, bad)).otherwise(out)
    return out


def _finding_count(strict_bases: bool, detect_quality: bool) -> Column:
    """How many findings a record has, without listing them."""
    n = sum((F.when(cond, 1).otherwise(0) for cond, _, _ in _checks(strict_bases)), F.lit(0))
    return n + F.when(F.col("n_lines") == 4, F.coalesce(bad_quality_bytes(F.col("qual")), F.lit(0))).otherwise(0) if detect_quality else n


def errors(reads: DataFrame, strict_bases: bool = False, detect_quality: bool = False) -> DataFrame:
    """file, record_index, line, code, message: one row an error."""
    rows = reads.select("file", "record_index", "line", F.explode(findings(strict_bases, detect_quality)).alias("e"))
    return rows.select("file", "record_index", "line", "e.code", "e.message")


def warnings(reads: DataFrame) -> DataFrame:
    """The soft checks of the quality summary: bad headers, plus lines and lengths; the reads still count."""
    return errors(reads).where(F.col("code").isin("header", "plus", "length"))


def _stat_columns(strict_bases: bool, detect_quality: bool) -> list[Column]:
    whole = F.col("n_lines") == 4
    size = F.when(whole, _length("seq"))
    letters = F.array_remove(F.split("qual", ""), "")
    least, most = (F.ascii(F.array_min(letters)), F.ascii(F.array_max(letters))) if detect_quality else (F.lit(None).cast("int"), F.lit(None).cast("int"))
    return [
        F.sum(whole.cast("int")).alias("total_reads"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bases"), F.min(size).alias("min_read_len"), F.max(size).alias("max_read_len"),
        F.min(F.when(whole, least)).alias("min_qual_ascii"), F.max(F.when(whole, most)).alias("max_qual_ascii"), F.sum(_finding_count(strict_bases, detect_quality)).alias("errors"),
    ]


_STATS = ["total_reads", "total_bases", "min_read_len", "max_read_len", "min_qual_ascii", "max_qual_ascii", "errors", "phred_detected"]


def _platform_columns(sample: int) -> list[Column]:
    looked = (F.col("record_index") <= sample) & (F.col("n_lines") == 4)
    # The index is tested first, so only the sample's headers meet the patterns.
    return [F.count_if(looked).alias("platform_reads_sampled"), *[F.count_if(F.when(looked, F.col("header").rlike(p))).alias(f"h{i}") for i, p in enumerate(PLATFORMS.values())]]


def _platform_of() -> list[Column]:
    best = F.array_max(F.array(*[F.struct(F.col(f"h{i}").alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(PLATFORMS)]))
    share = F.coalesce(best["n"] / F.nullif(F.col("platform_reads_sampled"), F.lit(0)), F.lit(0.0))
    return [F.when(share >= SURE, best["name"]).otherwise("Unknown").alias("platform_inferred"), F.round(share, 3).alias("platform_confidence"), F.coalesce("platform_reads_sampled", F.lit(0)).alias("platform_reads_sampled")]


def _with_files(rows: DataFrame, files: list[str] | None) -> DataFrame:
    """The rows of these files, one each, nulls for a file without records."""
    if files is None:
        return rows
    names = rows.sparkSession.createDataFrame([(f,) for f in files], "file string")
    return F.broadcast(names).join(rows, "file", "left") if files else rows


def file_stats(reads: DataFrame, strict_bases: bool = False, detect_quality: bool = False, files: list[str] | None = None) -> DataFrame:
    """A row a file: reads, bases, length and quality ranges, errors. Truncated records are errors, not reads.

    ``files`` names all files, so that those without a record get a row of zeros.
    """
    out = _with_files(reads.groupBy("file").agg(*_stat_columns(strict_bases, detect_quality)), files)
    label = phred_label(F.col("min_qual_ascii"), F.col("max_qual_ascii")) if detect_quality else F.lit(None).cast("string")
    return out.fillna(0, ["total_reads", "total_bases", "errors"]).withColumn("phred_detected", label)


def platform(reads: DataFrame, sample: int = SAMPLE, files: list[str] | None = None) -> DataFrame:
    """A row a file: platform_inferred, platform_confidence (3 decimals) and platform_reads_sampled.

    The first ``sample`` records of each file are looked at; a header may match several platforms, and of equal
    counts the last platform wins. Below four fifths, and for a file of ``files`` without records, it is Unknown.
    """
    rows = reads.where((F.col("record_index") <= sample) & (F.col("n_lines") == 4))
    return _with_files(rows.groupBy("file").agg(*_platform_columns(sample)), files).select("file", *_platform_of())


def file_report(reads: DataFrame, strict_bases: bool = False, detect_quality: bool = False, sample: int = SAMPLE, files: list[str] | None = None) -> DataFrame:
    """:func:`file_stats` and :func:`platform` in one pass over the reads."""
    got = _with_files(reads.groupBy("file").agg(*_stat_columns(strict_bases, detect_quality), *_platform_columns(sample)), files).fillna(0, ["total_reads", "total_bases", "errors"])
    label = phred_label(F.col("min_qual_ascii"), F.col("max_qual_ascii")) if detect_quality else F.lit(None).cast("string")
    return got.withColumn("phred_detected", label).select("file", *_STATS, *_platform_of())


def report(stats: DataFrame, platforms: DataFrame | None, pairs: DataFrame | None, files: list[str]) -> DataFrame:
    """One row: read1, read2, paired, totals. ``files``: the one or two file names in order; inputs are a row a file.

    Stats that carry their platforms already (:func:`file_report`) need no ``platforms``.
    """
    rows = stats.join(platforms, "file", "left") if platforms is not None else stats if "platform_inferred" in stats.columns else stats.withColumns({"platform_inferred": F.lit(None).cast("string"), "platform_confidence": F.lit(None).cast("double"), "platform_reads_sampled": F.lit(None).cast("long")})
    names = ["total_reads", "total_bases", "min_read_len", "max_read_len", "min_qual_ascii", "max_qual_ascii", "phred_detected", "platform_inferred", "platform_confidence", "platform_reads_sampled", "errors"]
    side = F.struct(F.col("file").alias("path"), *names)
    pick = lambda f: F.max(F.when(F.col("file") == f, side))
    out = rows.agg(pick(files[0]).alias("read1"), (pick(files[1]) if len(files) > 1 else F.max(F.when(F.lit(False), side))).alias("read2"), F.sum("total_reads").alias("total_reads"), F.sum("total_bases").alias("total_bases"), F.sum("errors").alias("file_errors"))
    if pairs is None:
        return out.withColumnRenamed("file_errors", "errors")
    out = out.crossJoin(pairs.select(F.struct("pairs_checked", "name_mismatches", "unpaired_reads", "errors").alias("paired")))  # one row by one row
    return out.select("read1", "read2", "paired", "total_reads", "total_bases", (F.col("file_errors") + F.col("paired.errors")).alias("errors"))


def check_counts(batch_size: int = 8192, threads: int = 0, timeout: int = 60, decompress_threads: int = 8) -> None:
    """Argument checks of the command surface."""
    if batch_size <= 0:
        raise ValueError("batch size must be greater than 0")
    if decompress_threads <= 0:
        raise ValueError("decompression threads must be greater than 0")
    if threads < 0 or timeout < 1:
        raise ValueError("threads must not be negative, timeout must be 1 or more")
