"""Command line: ``python -m readloom qc|check|run-xml|archive|record ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from readloom.operators import inserts, validate
from readloom.plans import workflows


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom")
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("qc", help="quality summary of reads")
    q.add_argument("-i", dest="read1", required=True)
    q.add_argument("-I", dest="read2")
    q.add_argument("-o", dest="json_path")
    q.add_argument("-p", dest="tsv_prefix")
    q.add_argument("-s", dest="sample")
    q.add_argument("-percent", dest="percent", action="store_true")
    q.add_argument("-d", dest="decimals", type=int, default=6)
    q.add_argument("-is", dest="most_insert", type=int, default=inserts.MOST)
    q.add_argument("-6", "--phred64", dest="phred64", action="store_true")
    q.add_argument("--tsv-comma", action="store_true")
    q.add_argument("--json-comma", action="store_true")
    c = sub.add_parser("check", help="record and pairing checks")
    c.add_argument("--read1", "-1", required=True)
    c.add_argument("--read2", "-2")
    c.add_argument("--strict-bases", action="store_true")
    c.add_argument("--detect-quality", "--check-phred", dest="detect_quality", action="store_true")
    c.add_argument("--infer-platform", action="store_true")
    c.add_argument("--platform-sample-size", dest="sample", type=int, default=validate.SAMPLE)
    c.add_argument("--json-report", dest="json_path")
    x = sub.add_parser("run-xml", help="file table and scripts from a run's XML")
    x.add_argument("xml")
    x.add_argument("-o", dest="outdir", default=".")
    x.add_argument("-p", dest="prefix", required=True)
    a = sub.add_parser("archive", help="checksum files and scripts from a checksum list")
    a.add_argument("checksums")
    a.add_argument("root")
    a.add_argument("-p", dest="project", required=True)
    a.add_argument("-o", dest="outdir", default=".")
    r = sub.add_parser("record", help="manifest and scripts from a record's JSON")
    r.add_argument("payload")
    r.add_argument("-o", dest="outdir", default=".")
    r.add_argument("-p", dest="prefix", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    if command == "qc":
        print(workflows.quality(spark, **args))
    elif command == "check":
        text, good = workflows.check(spark, **args)
        print(text, end="")
        return 0 if good else 1
    else:
        {"run-xml": workflows.run_files, "archive": workflows.archive_files, "record": workflows.record_files}[command](spark, **args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
