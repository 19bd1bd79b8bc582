"""Catalogue queries over whole tables, reads and texts, against SQL and models that leave nothing out."""

import os
from collections import Counter

import duckdb

from readloom.plans import adapter, catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_urls_of_every_page(spark):
    got = sorted(tuple(r) for r in catalog.html_unique_url(spark, SF).select("page_id", "n", "url").collect())
    assert got == duckdb.sql(f"SELECT page_id, 1, concat('http://x.org/download/P', page_id) FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()
    assert max(r[0] for r in got) >= 10


def test_hashes_of_whole_reads(spark):
    reads = adapter.reads(spark, SF).selectExpr("record_index AS k", "seq").limit(300)
    got = {r.k: r for r in catalog.fnv1a_hash(spark, SF).join(reads, "k").collect()}
    assert len(got) == 300 and max(len(r.seq) for r in got.values()) > 100
    for r in got.values():
        h = 0xCBF29CE484222325
        for byte in r.seq.encode():
            h = (h ^ byte) * 0x100000001B3 % 2**64
        assert r.fnv1a == f"{h:016X}"


def test_profile_of_whole_texts(spark):
    got = {(r.cycle, r.code): r.n for r in catalog.text_profile(spark, SF).collect()}
    want = Counter()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall():
        want.update((i, ord(c) & 7) for i, c in enumerate((c for c in text if " " <= c <= "~"), 1))
    assert got == want and max(i for i, _ in want) > 150


def test_total_beyond_64_bits(spark, tmp_path):
    """Keys of a table 60 times sf0.1: the sum of sizes is above 2^63, DuckDB's sum without the cast has it too."""
    part = spark.read.parquet(f"{SF}/part.parquet").selectExpr("*", "explode(sequence(0, 1200000, 1000)) AS shift").selectExpr("p_partkey + shift AS p_partkey", "p_name", "p_brand", "p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.total_bytes(spark, str(tmp_path))
    rows = f"({catalog._FILES.replace('FROM part', f"FROM '{tmp_path}/part.parquet/*.parquet'")})"
    want = duckdb.sql(f"SELECT sum(size), count(*), count_if(url <> '') FROM {rows}").fetchall()[0]
    assert want[0] > 2**63 and tuple(got.first()) == want and dict(got.dtypes)["total_bytes"] == "decimal(38,0)"
    small = catalog.total_bytes(spark, SF)
    assert dict(small.dtypes)["total_bytes"] == "bigint" and small.first().total_bytes == duckdb.sql(f"SELECT sum(size) FROM ({catalog._FILES.replace('FROM part', f"FROM '{SF}/part.parquet'")})").fetchall()[0][0]
