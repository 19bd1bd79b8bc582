"""Chosen-path join, line deduplication and fingerprints against plain models."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from readloom.llm import chosen_path, lines, order_minhash


def _sets(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def _model(rows):
    """doc_id -> (class, links), by comparing all pairs."""
    sets = _sets(rows)
    n = len(sets)
    parent, links = list(range(n)), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if (len(a & b) / len(a | b) if a | b else 1) >= 0.8:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(sets[i][0], sets[root(i)][0], links[i]) for i in range(n)]


def _key(r):
    return tuple((v is not None, v) for v in r)


def test_join_on_awkward_rows(awkward, nothing):
    got = sorted(((r.doc_id, r.n_links) for r in chosen_path.join(awkward).collect()), key=_key)
    rows = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0]))
    assert got == sorted(((d, n) for d, _, n in _model(rows)), key=_key)
    assert chosen_path.join(nothing).count() == 0
    kept = chosen_path.keep_first(awkward)
    assert kept.columns == awkward.columns
    classes = {(r.class_id, ) for r in chosen_path.join(awkward).collect()}
    assert kept.count() == len(classes)
    assert chosen_path.keep_first(nothing).count() == 0


def test_join_of_a_large_group_in_blocks(spark, monkeypatch):
    """More alike documents than a bucket takes, beside others that share only a passage."""
    monkeypatch.setattr(chosen_path, "SMALL", 20)
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = word()
        rows.append((i, " ".join(w)))
    shared = " ".join(base[:60])
    rows += [(100 + i, shared + " " + " ".join(word() for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(docs).collect())
    assert got == sorted(_model(rows))


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.9) == 1 and chosen_path.runs_for(0.9999) == 4


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    m = chosen_path.min_hashes([np.unique(a), np.unique(b), np.zeros(0, np.uint64)])
    assert abs((m[0] == m[1]).mean() - 400 / 600) < 0.15 and (m[2] == 0xFFFFFFFF).all()


def _drop_lines(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        ls = text.split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append((doc_id, "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return out


def test_lines_against_a_plain_model(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcd") if rng.random() < 0.7 else f"u{rng.random()}" for _ in range(rng.randint(1, 12)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.drop_repeated(docs).collect())
    assert got == _drop_lines(rows)


def test_lines_on_awkward_rows(awkward, nothing):
    got = lines.drop_repeated(awkward)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[13].text == "x" and by[13].n_chars == 1 and by[15].text is None and by[14].text == ""
    assert by[12].text == {r.doc_id: r.text for r in awkward.collect()}[12]
    assert lines.drop_repeated(nothing).count() == 0


def test_fingerprints(awkward, nothing):
    rows = order_minhash.fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[10].fingerprint == by[10].fingerprint and by[14].fingerprint == by[15].fingerprint
    assert by[14].near_edited == 1.0 or by[14].n_chars == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.n_chars is not None for r in rows)
    assert by[16].near_edited > 0.05 and by[22].near_next == 1.0
    assert order_minhash.fingerprints(nothing).count() == 0
    assert order_minhash.fingerprints(awkward.where("doc_id = 16")).first().near_next == 1.0


def test_fingerprints_feel_order(spark):
    w = [f"w{i}" for i in range(200)]
    blocks = [w[i : i + 20] for i in range(0, 200, 20)]
    moved = [x for b in reversed(blocks) for x in b]
    rows = [(1, " ".join(w)), (3, " ".join(moved))]
    for k in range(12):
        few = w[:]
        few[16 * k + 5] = "other"
        rows.append((100 + k, " ".join(few)))
    sig = {r.doc_id: r.signature for r in order_minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: np.mean([x == y for x, y in zip(sig[a], sig[b], strict=True)])
    near = np.mean([like(1, 100 + k) for k in range(12)])  # a word of 200: three of 198 k-mers, two of which make a value
    assert near > 0.85 and like(1, 3) < near - 0.3


@pytest.mark.parametrize("n", [3, 7])
def test_edits(spark, n):
    texts = ["abcdefgh ij", "", "éö", "x", "hello world again", "漢字かな交じり", "end"][:n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import hashlib

    got = {r.doc_id: r.edited_sha256 for r in order_minhash.fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        follow = texts[i - 1]  # descending ids; after the least one comes the greatest
        cut = len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - cut] + follow[:cut]).encode()).hexdigest()
