"""Whole runs from files to files."""

import json
import os

from readloom.__main__ import main
from readloom.functions import texts as tf
from readloom.operators import manifest
from readloom.plans import workflows

READ1 = "".join(f"@r{i}/1\n{'ACGTACGTAC' * 5}\n+\n{'I' * 50}\n" for i in range(4))
READ2 = "".join(f"@r{i}/2\n{'GTACGTACGT' * 5}\n+\n{'5' * 50}\n" for i in range(3)) + "@other\nACGT\n+\nII!\n"


def test_quality_and_check(spark, tmp_path):
    a, b = tmp_path / "a_1.fq", tmp_path / "a_2.fq"
    a.write_text(READ1)
    b.write_text(READ2)
    text = workflows.quality(spark, str(a), str(b), str(tmp_path / "r.json"), str(tmp_path / "t"), percent=True, decimals=2)
    assert ">>>> Combined <<<<" in text and f"{'Q40 bases:':<20} {200:>12}  (100.00 %)" in text
    document = json.loads((tmp_path / "r.json").read_text())
    assert document["read1"]["total_reads"] == 4 and document["duplication"] == {"total": 4, "duplicates": 2, "rate": 50.0}
    assert sum(document["insert_size"]["histogram"]) == 4 and len(document["insert_size"]["histogram"]) == 513
    assert (tmp_path / "t_R1_summary.tsv").read_text().splitlines()[1].startswith("a_1\t4\t200\t50\t50")
    assert len((tmp_path / "t_combined_cycles.tsv").read_text().splitlines()) == 51
    single = workflows.quality(spark, str(a), tsv_prefix=str(tmp_path / "s"))
    assert single.startswith("=== QC Summary") and (tmp_path / "s_lengths.tsv").read_text() == "length\tcount\n50\t4\n"
    text, good = workflows.check(spark, str(a), str(b), True, True, True, json_path=str(tmp_path / "c.json"))
    report = json.loads((tmp_path / "c.json").read_text())
    assert not good and "Errors: 2" in text
    assert report["paired"] == {"pairs_checked": 4, "name_mismatches": 1, "unpaired_reads": 0, "errors": 1}
    assert report["read2"]["errors"] == 1 and report["read1"]["phred_detected"] == "Phred33"
    assert main(["check", "-1", str(a)]) == 0 and main(["check", "-1", str(a), "-2", str(b)]) == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<S><SRAFile filename="f" md5="m" semantic_name="fastq"><Alternatives url="https://b.s3.amazonaws.com/k" access_type="anonymous"/><Alternatives url="u" access_type="x"/></SRAFile></S>')
    assert workflows.run_files(spark, str(tmp_path / "x.xml"), str(tmp_path), "R").count() == 2
    assert (tmp_path / "R_download_md5.txt").read_text() == "m  f\n"
    aws = tmp_path / "R_download_aws_s3_cp.sh"
    assert "[[ -f ./k ]] || aws s3 cp --no-sign-request s3://b/k ./" in aws.read_text() and os.access(aws, os.X_OK)
    (tmp_path / "md5sum.txt").write_text("m1 ./P1/a.fq.gz\nm2 ./P1/b.bam\nbad\n")
    assert workflows.archive_files(spark, str(tmp_path / "md5sum.txt"), "https://d.ac.cn/P1", "P1", str(tmp_path)) == {"all_files": 2, "fastq": 1}
    assert (tmp_path / "run_download_fastq_using_axel.sh").read_text() == "axel --no-clobber -n 20 https://d.ac.cn/P1/a.fq.gz\n"
    (tmp_path / "r.json").write_text('{"files":[{"key":"a","size":2048,"checksum":"md5:ff","links":{"self":"u"}}]}')
    assert workflows.record_files(spark, str(tmp_path / "r.json"), str(tmp_path), "Z").count() == 1
    assert (tmp_path / "Z_manifest.tsv").read_text() == "filename\tsize\tsize_bytes\tmd5\turl\na\t2.00 KiB\t2048\tff\tu\n"
    entries = spark.createDataFrame([("m", "a.fq.gz"), ("m", "b")], "md5 string, path string")
    assert tuple(manifest.entry_counts(entries).first()) == (2, 1)
    from pyspark.sql import functions as F

    assert spark.range(1).select(tf.controlled(F.lit("x Controlled access y"))).first()[0]
