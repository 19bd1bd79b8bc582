"""The registered queries and the pipeline over the smallest tables."""

import hashlib
import zlib

import duckdb
import pytest

from readloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(registry.ORACLE[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == docs.count() and len({r.doc_id for r in rows}) == len(rows)
    if "payload_sha256" in rows[0]:
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        for r in rows:
            padded = texts[r.doc_id].ljust(r.payload_bytes, b"\0")
            assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("ids is null").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == out.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0, name
