"""Training-data operators against models that leave nothing out."""

import hashlib
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import chosen_path, gif, order_minhash, pieces


def _spark_hashes(spark, rows):
    """xxhash64 of each row of columns, in order."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"c{k} {'long' if isinstance(x, int) else 'string'}" for k, x in enumerate(rows[0])))
    return [r[0] for r in frame.select("i", F.xxhash64(*[c for c in frame.columns if c != "i"]).alias("h")).orderBy("i").select("h").collect()]


def test_every_order_ranks_all_numbered_kmers(spark):
    """A plain Order MinHash: all numbered k-mers ranked anew by each order, the least ones in text order."""
    om, r = order_minhash, random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, n) for _ in range(900)) for n in (2, 40, 4000)] + ["a b", "a b c d", "x " * 500, "漢字 かな交じりabc ไทย d", "one\ttwo\u00a0three\x0bfour five"]
    got = {x.doc_id: x.signature for x in om.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alone = lambda c: unicodedata.name(c, "-").split()[0] in ("CJK", "HIRAGANA", "KATAKANA", "THAI")
    cut = ~om._PLACE

    def split(t):
        out, inside = [], False
        for ch in t:
            if alone(ch):
                out, inside = [*out, ch], False
            elif ch in " \t\n\x0b\x0c\r":
                inside = False
            else:
                out[-1:] = [out[-1] + ch] if inside else [*out[-1:], ch]
                inside = True
        return out

    for d, t in enumerate(texts):
        w, seen = split(t), {}
        kmers = [tuple(w[i : i + om.K]) for i in range(max(1, len(w) - om.K + 1))]
        by_hash = [h & cut for h in _spark_hashes(spark, kmers)]
        for k in kmers:
            seen.setdefault(k, []).append(len(seen.get(k, [])) + 1)
        numbers = {k: iter(v) for k, v in seen.items()}
        numbered = [(h, next(numbers[k])) for h, k in zip(by_hash, kmers, strict=True)]
        schema = "h long, n int"
        names = [r.h if r.n == 1 else r.x & cut for r in spark.createDataFrame(numbered, schema).select("h", "n", F.xxhash64("h", "n").alias("x")).collect()]
        tuples = []
        for family in range(om.FAMILIES):
            own = names if not family else [x.x & cut for x in spark.createDataFrame([(x,) for x in names], "h long").select(F.xxhash64("h", F.lit(family)).alias("x")).collect()]
            for flip in range(om.FUNCTIONS // om.FAMILIES):
                mask = flip << (64 - om._BITS)
                rank = lambda i: ((own[i] | i) ^ mask) & (1 << 64) - 1
                order = sorted(range(len(own)), key=lambda i: rank(i) - (1 << 64) if rank(i) >= 1 << 63 else rank(i))
                tuples.append(([by_hash[i] for i in sorted(order[: om.L])], family, flip))
        want = [x.v for x in spark.createDataFrame([(i, *x) for i, x in enumerate(tuples)], "i int, k array<long>, family int, flip int").select("i", F.xxhash64("k", "family", "flip").bitwiseAND(0xFFFFFFFF).alias("v")).orderBy("i").collect()]
        assert got[d] == want, t[:40]


def test_likeness_follows_independent_orders(spark):
    """Orders that share a hash estimate the same likeness as orders that are all hashed apart."""
    r = random.Random(2)
    errors = []
    for n in (12, 60, 400):
        rows, pairs = [], []
        for k in range(60):
            a = [f"w{r.randrange(5000)}" for _ in range(n)]
            b = a[:]
            for _ in range(max(1, n // 30)):
                b[r.randrange(n)] = "other"
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
            pairs.append((a, b))
        sig = {x.doc_id: x.signature for x in order_minhash.signatures(spark.createDataFrame([(n * 1000 + i, t) for i, t in rows], "doc_id long, text string")).collect()}
        got = np.mean([np.mean([x == y for x, y in zip(sig[n * 1000 + 2 * k], sig[n * 1000 + 2 * k + 1], strict=True)]) for k in range(60)])
        want = []
        for a, b in pairs:
            ka, kb = ([tuple(x[i : i + 3]) for i in range(n - 2)] for x in (a, b))
            for seed in range(64):
                pick = lambda ks: [k for _, _, k in sorted(sorted((hashlib.blake2b(repr((seed, k)).encode(), digest_size=8).digest(), i, k) for i, k in enumerate(ks))[:2], key=lambda x: x[1])]  # noqa: E731, B023
                want.append(pick(ka) == pick(kb))
        errors.append(got - np.mean(want))
    assert max(map(abs, errors)) < 0.08, errors


def test_stored_media_are_dictionary_streams(spark, tmp_path):
    text = "to be or not to be " * 400
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in gif.query(spark, str(tmp_path)).collect()}
    assert rows[1].media_bytes < rows[1].n_bytes == len(text)
    assert rows[1].payload_sha256 == hashlib.sha256(gif.payload_of(np.frombuffer(text.encode(), np.uint8)).tobytes()).hexdigest()


def test_last_stage_decodes_its_ids(spark):
    texts = ["hello  world\n", "", None, "漢字 é"]
    rows = {r.doc_id: r for r in pieces.stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    for i, t in enumerate(texts):
        want = (None, None) if t is None else (hashlib.sha256(t.encode()).hexdigest(), len(t))
        assert (rows[i].decoded_sha256, rows[i].decoded_chars) == want


@pytest.mark.parametrize("recall", [0.9, 0.9999, 1 - 1e-9])
def test_recall_counts_the_sketch_filter(recall):
    share = (1 + recall) / 2
    least = chosen_path.agreements_for(share)
    n, s = chosen_path.COORDINATES, chosen_path.SIMILARITY
    missed = sum(math.comb(n, t) * s**t * (1 - s) ** (n - t) for t in range(least))
    assert missed + 0.0625 ** chosen_path.runs_for(share) <= 1 - recall
    assert chosen_path.agreements_for(1 - 1e-9) < chosen_path.agreements_for(0.9999) <= 84
