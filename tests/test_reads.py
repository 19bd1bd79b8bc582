"""Sources and operators over reads: hand-made files with known answers, and random models."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import reads as rf
from readloom.operators import duplicates, inserts, pairing, qc, validate
from readloom.plans import report
from readloom.sources.fastq import FastqSource, read_fastq
from readloom.streaming import reads as streaming

FASTQ = b"@a/1\nACGTN\n+\nIIII!\n@b\nACGTN\n+\n@@@@@\n@c x\nGGCC\n+c\n5555\n"


def _write(path, data):
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("split", ["128m", "7"])
@pytest.mark.parametrize("ending", ["lf", "crlf", "bare"])
def test_framing_holds_for_any_split(spark, tmp_path, split, ending):
    data = FASTQ.replace(b"\n", b"\r\n") if ending == "crlf" else FASTQ[:-1] if ending == "bare" else FASTQ
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_fastq(spark, _write(tmp_path / "a.fq", data)).orderBy("record_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.record_index, r.line, r.header, r.seq, r.plus, r.qual, r.n_lines) for r in rows] == [
        (1, 1, "@a/1", "ACGTN", "+", "IIII!", 4),
        (2, 5, "@b", "ACGTN", "+", "@@@@@", 4),
        (3, 9, "@c x", "GGCC", "+c", "5555", 4),
    ]


def test_compressed_members_and_missing_files(spark, tmp_path):
    two = gzip.compress(FASTQ) + gzip.compress(FASTQ)
    assert read_fastq(spark, _write(tmp_path / "a.fq.gz", two)).count() == 6
    with pytest.raises(FileNotFoundError):
        read_fastq(spark, str(tmp_path / "none.fq"))


def test_source_knows_gzip_by_its_bytes_and_keeps_errors(spark, tmp_path):
    _write(tmp_path / "plain", FASTQ + b"@d\nA\n+\n")
    _write(tmp_path / "zipped", gzip.compress(FASTQ))
    _write(tmp_path / "damaged", gzip.compress(FASTQ * 200, mtime=0)[:-12])
    spark.dataSource.register(FastqSource)
    rows = spark.read.format("fastq").load(str(tmp_path))
    n = {r[0].split("/")[-1]: (r[1], r[2]) for r in rows.groupBy("file").agg(F.count_if("n_lines = 4") if False else F.sum((F.col("n_lines") == 4).cast("int")), F.count("error")).collect()}
    assert n["plain"] == (3, 0) and n["zipped"] == (3, 0)
    assert n["damaged"][1] == 1
    assert {r.code for r in validate.errors(rows.where("file like '%plain'")).collect()} == {"truncated"}


def test_summary_and_curves(spark, tmp_path):
    reads = read_fastq(spark, _write(tmp_path / "a.fq", FASTQ))
    s = qc.summary(reads).first()
    assert (s.total_reads, s.total_bases, s.total_cycles, s.mean_length, s.gc_bases, s.q20_bases, s.q30_bases, s.q40_bases) == (3, 14, 5, 4, 8, 13, 9, 4)
    curve = {r.cycle: r for r in qc.curves(qc.per_cycle_counts(reads)).collect()}
    assert curve[1].mean_qual == pytest.approx((40 + 31 + 20) / 3) and curve[1].A_qual == pytest.approx(35.5)
    assert curve[1].T_qual == curve[1].mean_qual and curve[5].N_content == 1.0
    assert {r.qual_ascii: r.n for r in qc.quality_histogram(reads).collect()} == {33: 1, 53: 4, 64: 5, 73: 4}
    assert qc.summary(reads, percent=True).first().gc_content == pytest.approx(100 * 8 / 14)
    text = report.summary_text(s, curve.values())
    assert "Total bases:                   14" in text and "        1     30.33" in text
    document = report.document({"read1": report.read_json(s, qc.length_histogram(reads).collect(), curve.values(), qc.quality_histogram(reads).collect())}, None, duplicates.rate(reads, "seq").first(), None)
    assert '"rate": 0.333333' in document
    assert report.summary_tsv("x", s, 0.5).splitlines()[1].startswith("x\t3\t14\t5\t4\t8\t0.571429")


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "file string, record_index long, line long, header string, seq string, plus string, qual string, n_lines int")
    assert qc.summary(none).first().total_reads == 0 and qc.summary(none).first().gc_content == 0.0
    assert duplicates.rate(none, "seq").first().dup_rate == 0.0
    assert inserts.peak(inserts.histogram(none.select(F.col("seq").alias("seq1"), F.col("seq").alias("seq2")))).first().peak == 0
    assert validate.errors(none, True, True).count() == 0


def test_checks(spark):
    rows = [("f", 1, 1, "r", "", "x", "", 4), ("f", 2, 5, "@r", "ACGt", "+", "III", 4), ("f", 3, 9, "@r", "AC", "+", " \x7f", 4), ("f", 4, 13, "@r", "A", None, None, 2)]
    reads = spark.createDataFrame(rows, "file string, record_index long, line long, header string, seq string, plus string, qual string, n_lines int")
    got = sorted((r.record_index, r.code) for r in validate.errors(reads, True, True).collect())
    assert got == [(1, "empty"), (1, "header"), (1, "plus"), (2, "bases"), (2, "length"), (3, "quality"), (3, "quality"), (4, "truncated")]
    stats = validate.file_stats(reads, True, True).first()
    assert (stats.total_reads, stats.errors, stats.min_read_len, stats.max_read_len) == (3, 8, 0, 4)


@pytest.mark.parametrize(
    ("header", "name"),
    [("@A00459:371:H:1:1101:1000:2000 1:N:0:ACGT", "Illumina"), ("@E250122340L1C001R00100012764/1", "BGI/MGI"), ("@m1/12/0_55 x", "PacBio"), ("@ab-1 runid=0f ch=3 start_time=t", "Oxford Nanopore"), ("@E00491:123:HX:1:1101:1000:2000", "BGI/MGI"), ("@plain", "Unknown")],
)
def test_platform(spark, header, name):
    reads = spark.createDataFrame([("f", 1, header, 4)], "file string, record_index long, header string, n_lines int")
    assert validate.platform(reads).first().platform_inferred == name


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    ids = {"@x/1 y": "x", "@x/2": "x", "x\ty": "x", "@x/3": "x/3"}
    for header, want in ids.items():
        assert one(rf.read_id(F.lit(header))) == want
    labels = {(33, 74): "Phred33", (64, 104): "Phred64", (34, 123): "Unknown (ASCII 34-123)"}
    for (lo, hi), want in labels.items():
        assert one(rf.phred_label(F.lit(lo), F.lit(hi))) == want
    assert one(rf.reverse_complement(F.lit("ACgtNx"))) == "NNacGT"
    assert one(rf.phred64_to_33(F.lit("h@!"))) == "I!!"
    assert one(rf.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(rf.fnv1a(F.lit("a"))) == "AF63DC4C8601EC8C" and one(rf.fnv1a(F.lit(""))) == "CBF29CE484222325"


def _overlap_model(a, b):
    for shift in [*range(len(a) - 30), *range(-1, -(len(b) - 30), -1)]:
        n = min(len(a) - shift, len(b)) if shift >= 0 else min(len(a), len(b) + shift)
        x, y = (a[shift : shift + n], b[:n]) if shift >= 0 else (a[:n], b[-shift : n - shift])
        if sum(p != q for p, q in zip(x, y, strict=True)) <= min(5, int(n * 0.2)):
            return True, shift, n
    return False, 0, 0


def test_overlap_against_a_plain_model():
    rng = random.Random(3)
    first, second = [], []
    for _ in range(300):
        whole = "".join(rng.choices("ACGT", k=260))
        la, lb, at = rng.randint(0, 90), rng.randint(0, 90), rng.randint(0, 60)
        a, b = (whole[:la], whole[at : at + lb]) if rng.random() < 0.6 else (whole[at : at + la], whole[:lb])
        b = "".join(c if rng.random() > 0.03 else rng.choice("ACGTN") for c in b)
        first.append(a)
        second.append(b)
    first += ["A" * 30, "A" * 31]
    second += ["A" * 30, "A" * 31]
    found, shift, n = rf.overlap_batch(first, second)
    want = [_overlap_model(a, b) for a, b in zip(first, second, strict=True)]
    assert [tuple(x) for x in zip(found.tolist(), shift.tolist(), n.tolist(), strict=True)] == want
    assert np.sum(found) > 50 and (shift[found] < 0).any()


def test_pairing_and_duplicates(spark):
    a = spark.createDataFrame([(1, "@x/1", "A"), (2, "@y/1", "B"), (3, "@z/1", "A")], "record_index long, header string, seq string")
    b = spark.createDataFrame([(1, "@x/2", "C"), (2, "@q/2", "D")], "record_index long, header string, seq string")
    pairs = pairing.zipped(a, b)
    assert tuple(pairing.counters(pairs).first()) == (2, 1, 1, 2)
    assert pairing.pair_errors(pairs).count() == 2 and pairing.longer_side(a, b).first().longer == "read1"
    assert [r.is_duplicate for r in duplicates.flags(a, "record_index", "seq").orderBy("record_index").collect()] == [False, False, True]
    assert [r.is_duplicate for r in duplicates.flags_in_order(a, "record_index", "seq").orderBy("record_index").collect()] == [False, False, True]
    assert duplicates.rate(a, "seq", approximate=True).first().duplicates == 1


def test_stream_of_reads(spark, tmp_path):
    spark.createDataFrame([("ACGT", "IIII"), ("AC", "II")], "seq string, qual string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string, qual string").parquet(str(tmp_path / "in"))
    q = streaming.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("totals").first().total_bases == 6


@pytest.mark.parametrize(
    ("header", "name"),
    [
        ("@MGI01/12/0_500", "PacBio"),  # also of the pattern before it
        ("@BGI9 runid=ab ch=1 start_time=x", "Oxford Nanopore"),
        ("@A00:1:F:1:2:3:4", "Illumina"),
        ("@V3:1:F:1:2:3:4", "BGI/MGI"),  # also Illumina, which comes first
    ],
)
def test_platform_ties_go_to_the_later_one(spark, header, name):
    reads = spark.createDataFrame([("f", 1, header, 4)], "file string, record_index long, header string, n_lines int")
    assert validate.platform(reads).first().platform_inferred == name


def test_a_file_without_records(spark):
    columns = "file string, record_index long, line long, header string, seq string, plus string, qual string, n_lines int"
    reads = spark.createDataFrame([("a", 1, 1, "@r", "ACGT", "+", "II\x01I", 4), ("a", 2, 5, "r", "", "x", "", 4), ("a", 3, 9, "@t", None, None, None, 1)], columns)
    rows = {r.file: r for r in validate.file_report(reads, strict_bases=True, detect_quality=True, files=["a", "b"]).collect()}
    assert (rows["b"].total_reads, rows["b"].errors, rows["b"].platform_inferred, rows["b"].platform_confidence, rows["b"].phred_detected) == (0, 0, "Unknown", 0.0, "No qualities observed")
    found = [(r.record_index, r.code, r.message) for r in validate.errors(reads, strict_bases=True, detect_quality=True).collect()]
    assert found == [
        (1, "quality", "quality contains non-printable ASCII byte 1"),
        (2, "header", "header must start with '@': r"),
        (2, "empty", "sequence is empty"),
        (2, "plus", "plus line must start with '+': x"),
        (3, "truncated", "truncated record: missing sequence line"),
    ]
    assert rows["a"].errors == len(found) and rows["a"].total_reads == 2
    apart = validate.file_stats(reads, True, True, ["a", "b"]).join(validate.platform(reads, files=["a", "b"]), "file")
    names = sorted(apart.columns)
    assert sorted(map(str, apart.select(names).collect())) == sorted(str(r) for r in validate.file_report(reads, True, True, files=["a", "b"]).select(names).collect())


def test_pairs_from_one_table(spark):
    both = spark.createDataFrame([("x", 1, "@a/1"), ("y", 1, "@a/2"), ("x", 2, "@b"), ("y", 3, "@c")], "file string, record_index long, header string")
    got = {r.record_index: (r.r1 and r.r1.header, r.r2 and r.r2.header) for r in pairing.by_position(both, "x", "y").collect()}
    assert got == {1: ("@a/1", "@a/2"), 2: ("@b", None), 3: (None, "@c")}


def test_cycle_counts_against_plain_counting(spark):
    rows = [("ACGTN", "I5?#I"), ("AC", "I"), ("", ""), ("GGG", None), (None, "I"), ("acX", "III!!")]
    reads = spark.createDataFrame(rows, "seq string, qual string").repartition(3)
    got = {(r.cycle, r.code): (r.n, r.n_q20, r.n_q30, r.sum_q) for r in qc.per_cycle_counts(reads).collect()}
    want, values = {}, {}
    for seq, qual in rows:
        for i, b in enumerate(seq or ""):
            q = ord(qual[i]) if qual and i < len(qual) else None
            n = want.setdefault((i + 1, ord(b) & 7), [0, 0, 0, 0])
            n[0] += 1
            if q is not None:
                n[1], n[2], n[3] = n[1] + (q >= 53), n[2] + (q >= 63), n[3] + q - 33
                values[q] = values.get(q, 0) + 1
    assert got == {k: tuple(v) for k, v in want.items()}
    assert {r.qual_ascii: r.n for r in qc.quality_histogram(reads).collect()} == values
