"""Registered queries of the read and manifest operators, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import reads as rf
from readloom.functions import texts as tf
from readloom.operators import duplicates, inserts, manifest, pairing, qc, validate
from readloom.plans import adapter
from readloom.sources import payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: CTEs that the SQL of read queries starts from
_PAIRS = f"WITH p AS ({adapter.PAIRS})"
_R1 = _PAIRS + ", r AS (SELECT k, header1 AS header, seq1 AS seq, qual1 AS qual FROM p)"
_BASE = _R1 + ", n AS (SELECT seq, qual, unnest(range(1, length(seq) + 1)) AS c FROM r), b AS (SELECT c, ord(substr(seq, c, 1)) & 7 AS code, CASE WHEN c <= length(qual) THEN ord(substr(qual, c, 1)) END AS q FROM n)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- quality summary ----------------------------------------------------------------------------


def _summary_sql(source: str) -> str:
    """The summary of a relation of seq and qual, behind CTEs."""
    return f""", s AS (SELECT seq, substr(qual, 1, length(seq)) AS qual FROM {source} WHERE length(seq) > 0),
    a AS (SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, max(length(seq)) AS cycles,
      CAST(sum(length(regexp_replace(seq, '[^CGKSWckgsw]', '', 'g'))) AS BIGINT) AS gc,
      CAST(sum(length(regexp_replace(qual, '[^5-~]', '', 'g'))) AS BIGINT) AS q20, CAST(sum(length(regexp_replace(qual, '[^?-~]', '', 'g'))) AS BIGINT) AS q30, CAST(sum(length(regexp_replace(qual, '[^I-~]', '', 'g'))) AS BIGINT) AS q40,
      count_if(length(seq) >= 20 AND ord(substr(qual, 20, 1)) >= 53) AS c20, count_if(length(seq) >= 20) AS n20 FROM s)
    SELECT reads AS total_reads, bases AS total_bases, CAST(cycles AS INTEGER) AS total_cycles, CAST(bases // reads AS BIGINT) AS mean_length, gc AS gc_bases, round(gc / bases, 6) AS gc_content,
      q20 AS q20_bases, round(q20 / bases, 6) AS q20_rate, q30 AS q30_bases, round(q30 / bases, 6) AS q30_rate, q40 AS q40_bases, round(q40 / bases, 6) AS q40_rate,
      CAST(c20 AS BIGINT) AS cycle20_bases, round(c20 / n20, 6) AS cycle20_rate FROM a"""


@query(_R1 + _summary_sql("r"))
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.summary(adapter.reads(spark, sf_dir)))


@query(_PAIRS + ", u AS (SELECT seq1 AS seq, qual1 AS qual FROM p UNION ALL SELECT seq2, qual2 FROM p WHERE seq2 IS NOT NULL)" + _summary_sql("u"))
def combined_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapter.pairs(spark, sf_dir)
    return _rounded(qc.combined(adapter.side(p, 1), adapter.side(p, 2)))


_COUNTS = "SELECT c AS cycle, code, count(*) AS n, CAST(count_if(q >= 53) AS BIGINT) AS n_q20, CAST(count_if(q >= 63) AS BIGINT) AS n_q30, CAST(coalesce(sum(q - 33), 0) AS BIGINT) AS sum_q FROM b GROUP BY c, code"


@query(_BASE + f" SELECT CAST(cycle AS INTEGER) AS cycle, CAST(code AS INTEGER) AS code, n, n_q20, n_q30, sum_q FROM ({_COUNTS})")
def percycle_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.per_cycle_counts(adapter.reads(spark, sf_dir))


_CODE = {"A": 1, "T": 4, "C": 3, "G": 7, "N": 6}
_CURVES = _BASE + f", k AS ({_COUNTS}), m AS (SELECT cycle, sum(n) AS n, sum(sum_q) AS s FROM k GROUP BY cycle) SELECT CAST(k.cycle AS INTEGER) AS cycle, round(any_value(m.s) / any_value(m.n), 6) AS mean_qual, " + ", ".join(f"round(coalesce(sum(sum_q) FILTER (code = {_CODE[b]}) / nullif(sum(k.n) FILTER (code = {_CODE[b]}), 0), any_value(m.s) / any_value(m.n)), 6) AS \"{b}_qual\"" for b in "ATCG") + ", " + ", ".join(f"round(coalesce(sum(k.n) FILTER (code = {_CODE[b]}), 0) / any_value(m.n), 6) AS \"{b}_content\"" for b in "ATCGN") + ", round(coalesce(sum(k.n) FILTER (code IN (3, 7)), 0) / any_value(m.n), 6) AS \"GC_content\" FROM k JOIN m ON k.cycle = m.cycle GROUP BY k.cycle"


@query(_CURVES)
def percycle_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.curves(qc.per_cycle_counts(adapter.reads(spark, sf_dir))))


@query(f"SELECT cycle, mean_qual FROM ({_CURVES}) WHERE (cycle - 1) % (SELECT greatest(1, max(cycle) // 25) FROM ({_CURVES})) = 0")
def percycle_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.sampled(qc.curves(qc.per_cycle_counts(adapter.reads(spark, sf_dir)))))


@query(_BASE + " SELECT CAST(q AS INTEGER) AS qual_ascii, count(*) AS n FROM b WHERE q IS NOT NULL GROUP BY q")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.quality_histogram(adapter.reads(spark, sf_dir))


@query(_R1 + " SELECT CAST(length(seq) AS INTEGER) AS length, count(*) AS n FROM r GROUP BY length(seq)")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.length_histogram(adapter.reads(spark, sf_dir)).drop("share")


@query("SELECT CAST(length(text) AS INTEGER) AS length, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents WHERE length(text) > 0 GROUP BY length(text)")
def length_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.length_histogram(_t(spark, sf_dir, "documents"), "text"))


@query(
    "WITH d AS (SELECT regexp_replace(text, '[^ -~]', '', 'g') AS s FROM documents), c AS (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM d) SELECT CAST(i AS INTEGER) AS cycle, CAST(ord(substr(s, i, 1)) & 7 AS INTEGER) AS code, count(*) AS n FROM c GROUP BY ALL"
)
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.text_profile(_t(spark, sf_dir, "documents"), "text")


@query(_R1 + " SELECT k, translate(qual, '!\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~', '!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_') AS qual33 FROM r")
def phred64_to_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.reads(spark, sf_dir).select(F.col("record_index").alias("k"), rf.phred64_to_33(F.col("qual")).alias("qual33"))


# ---- duplicates ---------------------------------------------------------------------------------

_DUP = " SELECT count(*) AS total, count(*) - count(DISTINCT {key}) AS duplicates, round((count(*) - count(DISTINCT {key})) / count(*), 6) AS dup_rate FROM "


@query(_R1 + _DUP.format(key="seq") + "r")
def duplication_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(duplicates.rate(adapter.reads(spark, sf_dir), "seq"))


@query(_PAIRS + _DUP.format(key="(seq1, seq2)") + "p WHERE seq2 IS NOT NULL")
def duplication_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(duplicates.rate(adapter.pairs(spark, sf_dir).where("seq2 IS NOT NULL"), "seq1", "seq2"))


@query(_DUP.format(key="text") + "documents")
def duplication_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(duplicates.rate(_t(spark, sf_dir, "documents"), "text"))


@query(_R1 + " SELECT k, row_number() OVER (PARTITION BY seq ORDER BY k) > 1 AS is_duplicate FROM r")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.reads(spark, sf_dir).select(F.col("record_index").alias("k"), "seq")
    return duplicates.flags(rows, "k", "seq").select("k", "is_duplicate")


@query()
def duplication_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(duplicates.rate(adapter.reads(spark, sf_dir), "seq", approximate=True))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(seq, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(_R1 + f" SELECT k, printf('%016X', {_FNV}::UBIGINT) AS fnv1a FROM r")
def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.reads(spark, sf_dir).select(F.col("record_index").alias("k"), rf.fnv1a(F.col("seq")).alias("fnv1a"))


# ---- overlap and insert size --------------------------------------------------------------------


@query(_R1 + " SELECT k, reverse(translate(regexp_replace(seq, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS rc FROM r")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.reads(spark, sf_dir).select(F.col("record_index").alias("k"), rf.reverse_complement(F.col("seq")).alias("rc"))


_ISIZE = (
    _PAIRS
    + """, q AS (SELECT k, seq1 AS a, reverse(translate(regexp_replace(seq2, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS b FROM p WHERE seq2 IS NOT NULL),
f AS (SELECT k, a, b, unnest(range(0, length(a) - 30)) AS o FROM q),
fh AS (SELECT k, min(o) AS o FROM (SELECT k, o, least(length(a) - o, length(b)) AS l, a, b FROM f) WHERE hamming(substr(a, o + 1, l), substr(b, 1, l)) <= least(5, floor(l * 0.2)) GROUP BY k),
g AS (SELECT k, a, b, unnest(range(1, length(b) - 30)) AS o FROM q ANTI JOIN fh USING (k)),
gh AS (SELECT k, min(o) AS o FROM (SELECT k, o, least(length(a), length(b) - o) AS l, a, b FROM g) WHERE hamming(substr(a, 1, l), substr(b, o + 1, l)) <= least(5, floor(l * 0.2)) GROUP BY k),
i AS (SELECT q.k, CAST(least(512, CASE WHEN fh.o > 0 THEN length(a) + length(b) - least(length(a) - fh.o, length(b)) WHEN fh.o = 0 THEN least(length(a), length(b)) WHEN gh.o IS NOT NULL THEN least(length(a), length(b) - gh.o) ELSE 512 END) AS INTEGER) AS insert_size FROM q LEFT JOIN fh USING (k) LEFT JOIN gh USING (k))"""
)


@query(_ISIZE + " SELECT insert_size, count(*) AS n FROM i GROUP BY insert_size")
def insert_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inserts.histogram(adapter.pairs(spark, sf_dir).where("seq2 IS NOT NULL").select("seq1", "seq2"))


@query(
    _ISIZE
    + ", h AS (SELECT insert_size, count(*) AS n FROM i GROUP BY insert_size) SELECT coalesce((SELECT insert_size FROM h WHERE insert_size < 512 ORDER BY n DESC, insert_size LIMIT 1), 0) AS peak, CAST(coalesce(sum(n) FILTER (insert_size = 512), 0) AS BIGINT) AS unknown, CAST(sum(n) AS BIGINT) AS pairs FROM h"
)
def insert_size_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inserts.peak(inserts.histogram(adapter.pairs(spark, sf_dir).where("seq2 IS NOT NULL").select("seq1", "seq2")))


# ---- validation ---------------------------------------------------------------------------------

_FAULTS = """SELECT k AS record_index, CAST(k * 4 + 1 AS BIGINT) AS line, 'header' AS code FROM r WHERE NOT starts_with(header, '@')
UNION ALL SELECT k, k * 4 + 1, 'length' FROM r WHERE length(seq) <> length(qual)
UNION ALL SELECT k, k * 4 + 1, 'bases' FROM r WHERE regexp_matches(seq, '[^ACGTN]')"""


@query(f"{_R1} {_FAULTS}")
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.errors(adapter.reads(spark, sf_dir), strict_bases=True, detect_quality=True).select("record_index", "line", "code")


@query(_R1 + " SELECT k AS record_index FROM r WHERE regexp_matches(seq, '[^ACGTN]')")
def strict_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.errors(adapter.reads(spark, sf_dir), strict_bases=True).where("code = 'bases'").select("record_index")


@query("SELECT doc_id, CAST(strlen(text) - (length(text) - length(regexp_replace(text, '[!-~]', '', 'g'))) AS BIGINT) AS bad FROM documents")
def quality_ascii_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", validate.bad_quality_bytes(F.col("text")).cast("long").alias("bad"))


_STATS = " SELECT 'R1' AS file, count(*) AS total_reads, CAST(sum(length(seq)) AS BIGINT) AS total_bases, CAST(min(length(seq)) AS INTEGER) AS min_read_len, CAST(max(length(seq)) AS INTEGER) AS max_read_len, CAST((SELECT min(q) FROM x) AS INTEGER) AS min_qual_ascii, CAST((SELECT max(q) FROM x) AS INTEGER) AS max_qual_ascii, (SELECT count(*) FROM e) AS errors FROM r"
_STATS_CTE = _R1 + f", e AS ({_FAULTS}), n AS (SELECT qual, unnest(range(1, length(qual) + 1)) AS c FROM r), x AS (SELECT ord(substr(qual, c, 1)) AS q FROM n)"


@query(_STATS_CTE + _STATS)
def validate_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.file_stats(adapter.reads(spark, sf_dir), strict_bases=True, detect_quality=True).drop("phred_detected")


_PHRED = "CASE WHEN {lo} >= 33 AND {hi} <= 74 THEN 'Phred33' WHEN {lo} >= 64 AND {hi} <= 104 THEN 'Phred64' WHEN {lo} IS NOT NULL THEN concat('Unknown (ASCII ', {lo}, '-', {hi}, ')') END"


@query(_STATS_CTE + f", s AS ({_STATS}) SELECT file, min_qual_ascii, max_qual_ascii, {_PHRED.format(lo='min_qual_ascii', hi='max_qual_ascii')} AS phred_detected FROM s")
def detect_phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.file_stats(adapter.reads(spark, sf_dir), detect_quality=True).select("file", "min_qual_ascii", "max_qual_ascii", "phred_detected")


#: the SQL's own list, apart from the operator's: the order in which equal counts are decided, the last one winning
_PLATFORMS = ["Illumina", "BGI/MGI", "PacBio", "Oxford Nanopore"]
_HITS = ", ".join(f"count_if(regexp_matches(header, '{rf.PLATFORMS[n]}')) AS h{i}" for i, n in enumerate(_PLATFORMS))


@query(
    _R1
    + f", h AS (SELECT count(*) AS n, {_HITS} FROM r WHERE k <= 10000), v AS (SELECT n, unnest([{', '.join(f'{{i: {i}, name: {n!r}, hits: h{i}}}' for i, n in enumerate(_PLATFORMS))}]) AS s FROM h), w AS (SELECT * FROM v ORDER BY s.hits DESC, s.i DESC LIMIT 1) SELECT 'R1' AS file, CASE WHEN s.hits / n >= 0.8 THEN s.name ELSE 'Unknown' END AS platform_inferred, round(s.hits / n, 3) AS platform_confidence, n AS platform_reads_sampled FROM w"
)
def infer_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.platform(adapter.reads(spark, sf_dir))


_OUTER = _PAIRS + ", a AS (SELECT k AS record_index, header1 AS h1 FROM p), c AS (SELECT k AS record_index, header2 AS h2 FROM p WHERE seq2 IS NOT NULL)"
_ID = "regexp_replace(regexp_extract({h}, '^@?([^ \t]*)', 1), '/[12]$', '')"
_COUNTERS = f"SELECT CAST(count_if(h1 IS NOT NULL AND h2 IS NOT NULL) AS BIGINT) AS pairs_checked, CAST(count_if({_ID.format(h='h1')} <> {_ID.format(h='h2')}) AS BIGINT) AS name_mismatches, CAST(count_if(h1 IS NULL OR h2 IS NULL) AS BIGINT) AS unpaired_reads FROM a FULL JOIN c USING (record_index)"


def _zip(spark: SparkSession, sf_dir: str, how: str = "full_outer") -> DataFrame:
    p = adapter.pairs(spark, sf_dir)
    return pairing.zipped(adapter.side(p, 1).select("record_index", "header", "seq"), adapter.side(p, 2).select("record_index", "header", "seq"), how)


@query(_OUTER + " SELECT record_index, h1, h2 FROM a FULL JOIN c USING (record_index)")
def pair_zip_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zip(spark, sf_dir).select("record_index", F.col("r1.header").alias("h1"), F.col("r2.header").alias("h2"))


@query("SELECT l_orderkey, a.l_partkey AS part1, b.l_partkey AS part2 FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a FULL JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)")
def pair_zip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    both = pairing.zipped(lines.where("l_linenumber = 1").drop("l_linenumber"), lines.where("l_linenumber = 2").drop("l_linenumber"), key="l_orderkey")
    return both.select("l_orderkey", F.col("r1.l_partkey").alias("part1"), F.col("r2.l_partkey").alias("part2"))


@query(_OUTER + " SELECT record_index, h1, h2 FROM a JOIN c USING (record_index)")
def pair_zip_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zip(spark, sf_dir, "inner").select("record_index", F.col("r1.header").alias("h1"), F.col("r2.header").alias("h2"))


@query(_OUTER + f" SELECT record_index, {_ID.format(h='h1')} AS id1, {_ID.format(h='h2')} AS id2, {_ID.format(h='h1')} <> {_ID.format(h='h2')} AS differs FROM a JOIN c USING (record_index)")
def pair_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.name_check(_zip(spark, sf_dir))


@query(_OUTER + f", s AS ({_COUNTERS}) SELECT *, name_mismatches + unpaired_reads AS errors FROM s")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.counters(_zip(spark, sf_dir))


@query(
    _OUTER
    + f", r AS (SELECT k, header1 AS header, seq1 AS seq, qual1 AS qual FROM p), r2 AS (SELECT k, header2 AS header, seq2 AS seq, qual2 AS qual FROM p WHERE seq2 IS NOT NULL), e AS ({_FAULTS}), e2 AS ({_FAULTS.replace('FROM r ', 'FROM r2 ')}), s AS ({_COUNTERS}) SELECT (SELECT count(*) FROM r) AS reads1, (SELECT count(*) FROM r2) AS reads2, pairs_checked, (SELECT count(*) FROM r) + (SELECT count(*) FROM r2) AS total_reads, CAST((SELECT sum(length(seq)) FROM r) + (SELECT sum(length(seq)) FROM r2) AS BIGINT) AS total_bases, (SELECT count(*) FROM e) + (SELECT count(*) FROM e2) + name_mismatches + unpaired_reads AS errors FROM s"
)
def check_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = adapter.both(adapter.pairs(spark, sf_dir))
    pairs = pairing.by_position(both.select("file", "record_index", "header"), "R1", "R2")
    out = validate.report(validate.file_report(both, strict_bases=True), None, pairing.counters(pairs), ["R1", "R2"])
    return out.select(F.col("read1.total_reads").alias("reads1"), F.col("read2.total_reads").alias("reads2"), "paired.pairs_checked", "total_reads", "total_bases", "errors")


# ---- manifests ----------------------------------------------------------------------------------

#: parts as a file table, in SQL for both engines
_FILES = "SELECT p_partkey, concat('file ', cast(p_partkey AS string), '.fastq.gz') AS filename, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN concat('https://b', cast(p_partkey AS string), '.s3.amazonaws.com/k/', cast(p_partkey AS string), '?v=1') WHEN p_partkey % 4 = 2 THEN concat('s3://b/k/', cast(p_partkey AS string)) ELSE concat('https://x.org/it''s/', cast(p_partkey AS string)) END AS url, md5(p_name) AS md5, CASE WHEN p_partkey % 3 = 0 THEN 'aws identity' ELSE 'anonymous' END AS access_type, p_brand AS semantic_name, cast(p_partkey * p_partkey * p_size * 7 AS bigint) AS size FROM part"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FILES.replace("FROM part", "FROM {part}").replace("it''s", "it\\'s"), part=_t(spark, sf_dir, "part"))


@query(f"SELECT p_partkey, url FROM ({_FILES}) WHERE access_type = 'anonymous' AND url <> ''")
def manifest_anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.downloadable(_files(spark, sf_dir)).select("p_partkey", "url")


@query(f"SELECT concat(md5, '  ', filename) AS line FROM ({_FILES})")
def manifest_md5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.md5_lines(_files(spark, sf_dir))


_QUOTE = "CASE WHEN {x} = '' THEN '''''' WHEN regexp_matches({x}, '[^A-Za-z0-9_@%+=:,./-]') THEN concat('''', replace({x}, '''', '''\"''\"'''), '''') ELSE {x} END"


@query(
    f"WITH f AS (SELECT * FROM ({_FILES}) WHERE access_type = 'anonymous' AND url <> '') SELECT concat('# filename: ', filename, '; semantic_name: ', semantic_name, chr(10), 'wget -c -O ', {_QUOTE.format(x='filename')}, ' ', {_QUOTE.format(x='url')}, chr(10)) AS line FROM f"
)
def manifest_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.commands(manifest.downloadable(_files(spark, sf_dir)), "wget")


_S3 = r"CASE WHEN starts_with(url, 's3://') THEN url WHEN regexp_matches(url, '^https?://[^/?#]*\.s3\.amazonaws\.com([/?#]|\z)') THEN concat('s3://', regexp_extract(url, '^https?://([^/?#]*)\.s3\.amazonaws\.com', 1), regexp_extract(url, '^https?://([^/?#]*)\.s3\.amazonaws\.com(/[^?#;]*)?', 2)) END"


@query(f"SELECT p_partkey, {_S3} AS s3 FROM ({_FILES})")
def manifest_s3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("p_partkey", tf.s3_url(F.col("url")).alias("s3"))


@query(f"SELECT p_partkey, {_QUOTE.format(x='url')} AS quoted, concat('''', replace(url, '''', '''\"''\"'''), '''') AS always FROM ({_FILES})")
def shell_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("p_partkey", tf.shell_quote(F.col("url")).alias("quoted"), tf.shell_quote_always(F.col("url")).alias("always"))


_RECORD = "CASE p_partkey % 5 WHEN 0 THEN cast(p_partkey AS string) WHEN 1 THEN concat('https://zenodo.org/records/', cast(p_partkey AS string)) WHEN 2 THEN concat('DOI: 10.5281/Zenodo.', cast(p_partkey AS string)) WHEN 3 THEN concat(' https://doi.org/10.5281/zenodo.', cast(p_partkey AS string)) ELSE 'none' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN cast(p_partkey AS string) END AS record_id FROM part")
def record_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", tf.record_id(F.expr(_RECORD)).alias("record_id"))


def _size_sql() -> str:
    steps = " ".join(f"WHEN size < {1024 ** (p + 1)} THEN concat(printf('%.2f', size / {1024**p}.0), ' {u}')" for p, u in ((1, "KiB"), (2, "MiB"), (3, "GiB")))
    return f"CASE WHEN size < 1024 THEN concat(size, ' B') {steps} ELSE concat(printf('%.2f', size / {1024**4}.0), ' TiB') END"


@query(f"SELECT p_partkey, {_size_sql()} AS human FROM ({_FILES})")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("p_partkey", tf.human_size(F.col("size")).alias("human"))


_PROJECT = "CASE p_partkey % 5 WHEN 0 THEN concat('CRA', lpad(cast(p_partkey AS string), 6, '0')) WHEN 1 THEN concat('HRA', lpad(cast(p_partkey AS string), 6, '0')) WHEN 2 THEN concat('https://download.cncb.ac.cn/gsa/CRA', cast(p_partkey AS string), '/') WHEN 3 THEN 'CRA0001123' ELSE 'PRJ1' END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'human' WHEN 2 THEN 'url' ELSE 'unsupported' END AS kind, p_partkey % 5 < 4 AS loose, CASE p_partkey % 5 WHEN 1 THEN concat('https://download.cncb.ac.cn/gsa-human/HRA', lpad(cast(p_partkey AS string), 6, '0')) WHEN 2 THEN concat('https://download.cncb.ac.cn/gsa/CRA', cast(p_partkey AS string)) END AS root FROM part")
def project_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(_PROJECT)
    return _t(spark, sf_dir, "part").select("p_partkey", tf.project_kind(p).alias("kind"), tf.looks_like_project(p).alias("loose"), tf.download_root(p).alias("root"))


@query("SELECT p_partkey, concat('download.cncb.ac.cn:gsa/CRA', cast(p_partkey AS string), '/x.ac.cn/y') AS root FROM part")
def aspera_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://download.cncb.ac.cn/gsa/CRA"), F.col("p_partkey").cast("string"), F.lit("/x.ac.cn/y/"))
    return _t(spark, sf_dir, "part").select("p_partkey", tf.aspera_root(url).alias("root"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('r', cast(p_partkey AS string), '/P1/a.fq.gz') ELSE concat('x/', cast(p_partkey AS string)) END AS path FROM part")
def path_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('./P1/r', cast(p_partkey AS string), '/P1/a.fq.gz') ELSE concat('x/', cast(p_partkey AS string)) END")
    return _t(spark, sf_dir, "part").select("p_partkey", tf.path_after(path, F.lit("P1")).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('s', cast(p_partkey AS string)) WHEN 1 THEN concat('s', cast(p_partkey AS string), '.bam') ELSE 'sample' END AS sample FROM part")
def sample_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('/a/s', cast(p_partkey AS string), '.fastq.gz') WHEN 1 THEN concat('s', cast(p_partkey AS string), '.bam.GZ') ELSE '/a/' END")
    return _t(spark, sf_dir, "part").select("p_partkey", tf.sample_name(path).alias("sample"))


@query("SELECT p_partkey, concat('https://eutils/efetch.fcgi?db=sra&id=', cast(p_partkey AS string), '%2C1&rettype=xml') AS url FROM part")
def endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.col("p_partkey").cast("string"), F.lit(",1"))
    return _t(spark, sf_dir, "part").select("p_partkey", tf.query_url("https://eutils/efetch.fcgi", db="sra", id=ids, rettype="xml").alias("url"))


@query("WITH e AS (SELECT event_id, concat('n', event_id) AS name, md5(event_type) AS md5 FROM events) SELECT event_id, name, CASE WHEN event_id % 2 = 0 THEN md5 ELSE '' END AS md5, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS size FROM e")
def json_files_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("concat('{\"files\":[{\"key\":\"n', event_id, '\",', if(event_id % 3 = 0, '', concat('\"size\":', event_id, ',')), '\"checksum\":\"', if(event_id % 2 = 0, 'md5:', 'sha:'), md5(event_type), '\",\"links\":{\"self\":\"u\"}},{\"key\":\"\",\"size\":1,\"checksum\":\"\",\"links\":{\"self\":\"u\"}}]}')")
    files = _t(spark, sf_dir, "events").select("event_id", F.explode(payloads.record_files(body)).alias("f")).select("event_id", "f.*")
    return manifest.usable(files).select("event_id", "name", "md5", "size")


_XML = "concat('<RUN accession=\"SRR', s_suppkey, '\"><SRAFiles><SRAFile cluster=\"public\" filename=\"f', s_suppkey, '\" url=\"parent\" size=\"', s_nationkey, '\">', if(s_suppkey % 2 = 0, '', concat('<Alternatives url=\"u1\" access_type=\"anonymous\" org=\"AWS\"/><Alternatives url=\"u2\" access_type=\"gcp identity\" org=\"GCP\"/>')), '</SRAFile></SRAFiles></RUN>')"


@query("SELECT concat('SRR', s_suppkey) AS run, concat('f', s_suppkey) AS filename, cast(s_nationkey AS string) AS size, coalesce(u, '') AS url, coalesce(CASE u WHEN 'u1' THEN 'AWS' WHEN 'u2' THEN 'GCP' END, '') AS org FROM supplier LEFT JOIN (VALUES ('u1'), ('u2')) AS a(u) ON s_suppkey % 2 = 1")
def xml_files_explode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").select(payloads.files_of_xml(F.expr(_XML)).alias("run"))
    rows = rows.select(F.col("run._accession").alias("run"), F.explode("run.SRAFiles.SRAFile").alias("f")).select("run", "f.*")
    rows = rows.select(*[F.col(c).alias(c.removeprefix("_")) for c in rows.columns])
    return manifest.flat_files(rows).select("run", "filename", "size", "url", "org")


@query("SELECT DISTINCT concat('SRR', s_suppkey) AS run FROM supplier")
def xml_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").select(F.explode(payloads.run_accessions(F.expr(_XML))).alias("run"))
    return manifest.runs(rows)


_HTML = "concat('<a href=http://x.org/download/P', page_id, '>d</a> http://x.org/other/P', page_id, ' study_id = \"', page_id, '\"', html, 'http://x.org/download/P', page_id, '<')"


@query("SELECT page_id, 1 AS n, concat('http://x.org/download/P', page_id) AS url FROM pages")
def html_unique_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", F.expr(_HTML).alias("html"))
    found = tf.project_urls(F.col("html"), F.concat(F.lit("P"), F.col("page_id").cast("string")))
    return pages.select("page_id", F.size(found).alias("n"), F.element_at(found, 1).alias("url"))


@query("SELECT page_id, cast(page_id AS string) AS study_id FROM pages")
def html_study_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tf.study_id(F.expr(_HTML)).alias("study_id"))


@query("SELECT md5(p_name) AS md5, concat('d/', p_partkey, '.fq.gz') AS path FROM part WHERE p_partkey % 3 = 0")
def md5_list_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "part").select(F.expr("concat(' ', md5(p_name), '  d/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.fq.gz' WHEN 1 THEN '.bam' ELSE ' .fq.gz' END)").alias("value"))
    return manifest.fastq_only(payloads.checksum_lines(lines))


@query("SELECT DISTINCT concat('SRR', o_custkey) AS run FROM orders")
def run_list_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.runs(_t(spark, sf_dir, "orders").select(F.expr("concat('SRR', o_custkey)").alias("run")))


@query("SELECT s_name AS name, cast(s_nationkey AS string) AS nation, '' AS segment FROM supplier UNION ALL SELECT c_name, cast(c_nationkey AS string), c_mktsegment FROM customer")
def union_schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    b = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return manifest.merged(a, b)


@query(f"SELECT CAST(sum(size) AS BIGINT) AS total_bytes, count(*) AS files, CAST(count_if(url <> '') AS BIGINT) AS with_url FROM ({_FILES})")
def total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum is exact. It has the SQL's type, BIGINT, wherever it fits (one row is looked at first), else DECIMAL(38,0); the SQL has no result then."""
    size = F.sum(F.col("size").cast("decimal(19,0)")).cast("decimal(38,0)")
    totals = _files(spark, sf_dir).agg(size.alias("total_bytes"), F.count("*").alias("files"), F.count_if(F.col("url") != "").alias("with_url"))
    fits = totals.where(~F.col("total_bytes").between(-(2**63), 2**63 - 1)).isEmpty()
    return totals.withColumn("total_bytes", F.col("total_bytes").cast("bigint")) if fits else totals
