"""Archive payloads, manifests and command lines."""

import shlex

import pytest
from pyspark.sql import functions as F

from readloom.functions import texts as tf
from readloom.operators import manifest
from readloom.sources import payloads, sinks

XML = """<SET><RUN accession="SRR1"><SRAFiles>
<SRAFile cluster="public" filename="f1" url="x" size="10" md5="m">
<Alternatives url="https://b.s3.amazonaws.com/k" free_egress="worldwide" access_type="anonymous" org="AWS"/>
<Alternatives url="gs://b/k" free_egress="-" access_type="gcp identity" org="GCP"/></SRAFile>
<SRAFile cluster="public" filename="f2" extra="zz" url="y"/>
</SRAFiles></RUN></SET>"""


def _one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_xml_table(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    flat = manifest.flat_files(payloads.read_file_elements(spark, str(tmp_path / "a.xml")))
    assert flat.columns == [*payloads.FILE_COLUMNS, "extra"]
    rows = sorted((r.filename, r.url, r.org, r.extra, r["size"]) for r in flat.collect())
    assert rows == [("f1", "gs://b/k", "GCP", "", "10"), ("f1", "https://b.s3.amazonaws.com/k", "AWS", "", "10"), ("f2", "", "", "zz", "")]
    assert [r.url for r in manifest.downloadable(flat).collect()] == ["https://b.s3.amazonaws.com/k"]
    sinks.write_table(flat, str(tmp_path / "out"))
    back = payloads.read_table(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))
    found = _one(spark, payloads.run_accessions(F.lit(XML)))
    assert found == ["SRR1"]
    assert _one(spark, payloads.record_ids(F.lit("<a><Id>7</Id><Id></Id></a>"))) == ["7"]


def test_record_json(spark):
    body = '{"files":[{"key":"a b","size":1436,"checksum":"md5:ff","links":{"self":"u"}},{"key":"c","checksum":"sha:1","links":{"self":"v"}},{"key":"d"}]}'
    files = spark.range(1).select(F.explode(payloads.record_files(F.lit(body))).alias("f")).select("f.*")
    kept = manifest.usable(files)
    assert [(r.filename, r["size"], r.size_bytes, r.md5) for r in manifest.manifest(kept).collect()] == [("a b", "1.40 KiB", 1436, "ff"), ("c", "0 B", 0, "")]
    assert [r.line for r in manifest.record_md5_lines(kept).collect()] == ["ff  a b"]
    assert manifest.record_commands(kept, "wget").first().line == "# a b (1.40 KiB)\nwget -c --content-disposition -O 'a b' 'u'"


@pytest.mark.parametrize(("size", "want"), [(92, "92 B"), (1436, "1.40 KiB"), (46046336, "43.91 MiB"), (4893001644, "4.56 GiB"), (1055105504, "1006.23 MiB"), (1152, "1.12 KiB"), (1024**5, "1024.00 TiB")])
def test_human_size(spark, size, want):
    assert _one(spark, tf.human_size(F.lit(size).cast("long"))) == want


@pytest.mark.parametrize("text", ["", "plain", "a b", "it's", "x=1&y", "é", "$HOME"])
def test_shell_quote(spark, text):
    assert _one(spark, tf.shell_quote(F.lit(text))) == shlex.quote(text)


@pytest.mark.parametrize(("url", "want"), [("s3://b/k", "s3://b/k"), ("https://b.s3.amazonaws.com/k/x?q=1", "s3://b/k/x"), ("http://a.b.s3.amazonaws.com", "s3://a.b"), ("https://x.org/k", None), ("ftp://b.s3.amazonaws.com/k", None), ("https://b.s3.amazonaws.com.evil/k", None)])
def test_s3_url(spark, url, want):
    assert _one(spark, tf.s3_url(F.lit(url))) == want


@pytest.mark.parametrize(("record", "want"), [("15596052", "15596052"), ("https://x/records/15", "15"), ("doi: 10.5281/ZENODO.7", "7"), ("https://x/api/records/3/files", "3"), ("zen", None)])
def test_record_id(spark, record, want):
    assert _one(spark, tf.record_id(F.lit(record))) == want


def test_archive_texts(spark):
    assert _one(spark, tf.aspera_root(F.lit("https://d.ac.cn/g/P1/"))) == "d.ac.cn:g/P1"
    assert _one(spark, tf.path_after(F.lit("./P1/a/P1/b"), F.lit("P1"))) == "a/P1/b"
    assert _one(spark, tf.project_name(F.lit("https://x/P1//"))) == "P1"
    assert _one(spark, tf.sample_name(F.lit("/a/b.fastq.gz"))) == "b" and _one(spark, tf.sample_name(F.lit(""))) == "sample"
    assert _one(spark, tf.study_id(F.lit("x study_id: '42' study_id 7"))) == "42"
    assert _one(spark, tf.archive_download_command("axel", F.lit("https://r"), F.lit("a/b"))) == "axel --no-clobber -n 20 https://r/a/b"
    assert _one(spark, tf.download_command("aws_s3_cp", F.lit("f"), F.lit("https://x.org/k"))) is None
    assert _one(spark, tf.thousands(F.lit(1234567))) == "1,234,567"
    with pytest.raises(ValueError, match="unsupported"):
        tf.download_command("curl", F.lit("f"), F.lit("u"))
    with pytest.raises(ValueError, match="no files"):
        manifest.require_rows(spark.range(0), "files")
    lines = spark.createDataFrame([("m  d/a.fq.gz",), ("only",), (" m2\tb.bam ",)], "value string")
    entries = payloads.checksum_lines(lines)
    assert sorted(r.line for r in manifest.path_md5_lines(entries).collect()) == ["m\ta.fq.gz", "m2\tb.bam"]
    assert manifest.fastq_only(entries).count() == 1


def test_written_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "line string")
    sinks.write_lines(rows, str(tmp_path / "s"), head=manifest.script(rows, "wget", "p"))
    assert spark.read.text(str(tmp_path / "s")).count() == 7
