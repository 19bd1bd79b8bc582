"""Models against plain formulas, enumeration and held-out labels; mixing against a plain model."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import lattice_lm, mixing, quality, toxicity
from readloom.llm.common import fold_of

SF = "/root/testdata/sf0.01"


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.vocabulary()
    p = {x: math.exp(v) for x, v in zip(lattice.pieces, lattice.logp, strict=True)}
    go, stop = math.exp(lattice.log_go), math.exp(lattice.log_stop)
    for word in [b"a", b"then", "été".encode(), b"\xff\x00z"]:
        whole, total = b" " + word, 0.0
        for k in range(len(whole)):
            for cuts in combinations(range(1, len(whole)), k):
                parts = [whole[a:b] for a, b in zip((0, *cuts), (*cuts, len(whole)), strict=True)]
                total += math.prod(p.get(x, 0.0) for x in parts) * go ** (len(parts) - 1) * stop
        got = lattice.log_words(np.frombuffer(whole, np.uint8)[None])[0]
        assert got == pytest.approx(math.log(total), rel=1e-9)


def test_vocabulary_scores_weight_the_lattice():
    lattice = lattice_lm.vocabulary()
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lattice_lm.VOCABULARY))
    logp = dict(zip(lattice.pieces, lattice.logp, strict=True))
    for a, b in ((b" the", b" then"), (b"ing", b"ed")):
        i, j = (m.piece_to_id(x.decode().replace(" ", "▁")) for x in (a, b))
        assert logp[a] - logp[b] == pytest.approx(math.log((10 - m.get_score(j)) / (10 - m.get_score(i))))
    first = np.array([x[0] == 0x20 for x in lattice.pieces])
    assert np.exp(lattice.logp[first]).sum() == pytest.approx(1) and np.exp(lattice.logp[~first]).sum() == pytest.approx(1)


def test_expectations_count_the_words():
    lattice = lattice_lm.vocabulary()
    words = np.frombuffer(b" then this", np.uint8).reshape(2, 5)
    counts = lattice.expect(words) / lattice_lm._UNIT
    first = sum(c for c, p in zip(counts, lattice.pieces, strict=True) if p[0] == 0x20)
    length = sum(c * len(p) for c, p in zip(counts, lattice.pieces, strict=True))
    assert first == pytest.approx(2, abs=1e-5) and length == pytest.approx(10, abs=1e-5)
    better = lattice.learned(lattice.expect(words), 2)
    assert better.log_words(words).sum() > lattice.log_words(words).sum()


def _tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return __import__("re").findall(r"[^\x20\x09-\x0D]+", low)


@pytest.mark.parametrize("cells", [8, 10_000])
def test_scores_are_the_marginal_over_classes(spark, cells):
    """The whole score by the plain formula: counts, discounts, lattice, sum over classes."""
    from collections import Counter

    rng = random.Random(3)
    words = {"en": ["the", "then", "sing", "a", "Rare"], "fr": ["le", "été", "sing", "chat"], None: ["x1", "a"]}
    rows = [(i, k, " ".join(rng.choices(words[k], k=rng.randint(0, 9))) + (f" new{i}" if i % 3 == 0 else "")) for i in range(90) for k in [rng.choice(list(words))]]
    rows += [(100, "zz", "le sing nowhere"), (101, "en", ""), (102, None, None)]  # zz has no training row
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("train", (F.col("doc_id") % 5 != 0) & (F.col("doc_id") != 100))
    got = {r.doc_id: r for r in lattice_lm.score(docs, "lang", cells=cells, rounds=2).collect()}
    lattices = []
    for k in words:
        types = sorted({w for i, z, t in rows if z == k and i % 5 and i != 100 for w in _tokens(t)})
        lattices.append(lattice_lm.vocabulary())
        for _ in range(2):
            uses = sum(lattices[-1].expect(np.frombuffer(b" " + w.encode(), np.uint8)[None]) for w in types)
            lattices[-1] = lattices[-1].learned(uses, len(types))
    spell = lambda z, w: math.exp(lattices[z].log_words(np.frombuffer(b" " + w.encode(), np.uint8)[None])[0])

    def part(own):
        c = Counter(w for _, _, t in own for w in _tokens(t))
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        return c, sum(c.values()), len(c), once / (once + 2 * twice) if once and twice else 0.5, len(own)

    train = [r for r in rows if r[0] % 5 != 0 and r[0] != 100]
    c, w, v, d, n = part(train)
    parts = [part([r for r in train if r[1] == k]) for k in words]
    p0 = lambda x: (max(c[x] - d, 0) + (d * v + 0.5) * sum(parts[z][4] / n * spell(z, x) for z in range(3))) / (w + 0.5)
    for doc_id, _, text in rows:
        total = 0.0
        for z, (cz, wz, vz, dz, nz) in enumerate(parts):
            p = nz / n * nz / (wz + nz + 0.5)
            for x in _tokens(text):
                p *= (max(cz[x] - dz, 0) + (dz * vz + 0.5) * (p0(x) + spell(z, x)) / 2) / (wz + nz + 0.5)
            total += p
        assert got[doc_id].score == pytest.approx(math.log10(total), rel=1e-9)
    assert sum(nz for *_, nz in parts) == n and got[100].n_tokens == 4


def test_many_classes_are_all_classes(spark):
    docs = spark.createDataFrame([(i, f"k{i % 30}", f"w{i % 30} same") for i in range(120)], "doc_id long, lang string, text string").withColumn("train", F.lit(True))
    _, n = lattice_lm.with_kinds(docs, "lang")
    scores = [r.score for r in lattice_lm.score(docs, "lang").collect()]
    assert n == 30 and max(scores) - min(scores) < 0.1  # all classes are alike but for their word


def test_base_scores(awkward, nothing):
    docs = awkward.withColumn("train", fold_of("doc_id", 10) != 0)
    rows = lattice_lm.score(docs, cells=3).collect()
    tokens = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    from collections import Counter

    held = {(r.doc_id, r.train) for r in rows}
    train = dict(held)
    counts = Counter(w for r in awkward.collect() if train[r.doc_id] for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), round(base(r.text), 6)) for r in awkward.collect())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert got == want and all(r.train_tokens == n and r.score < 0 for r in rows)
    again = lattice_lm.score(docs).collect()
    assert sorted(round(r.score, 6) for r in again) == sorted(round(r.score, 6) for r in rows)
    assert lattice_lm.score(nothing.withColumn("train", F.lit(True))).count() == 0
    only_held = lattice_lm.score(awkward.withColumn("train", F.lit(False)))
    assert only_held.where("n_known > 0 or base_score <> 0 or score >= 0").count() == 0


def _bag(rng, toxic):
    sentences = []
    for _ in range(rng.randint(1, 8)):
        sentences.append(" ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 5))) for _ in range(rng.randint(3, 9))))
    if toxic:
        k = rng.randrange(len(sentences))
        sentences[k] += " zork" + rng.choice(["", "ing", "ed", "est"])
    return ". ".join(sentences) + "."


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(6)
    rows = [(i, _bag(rng, i % 5 == 0), i % 5 == 0) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, int(r[2])) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i].score >= 0.7) == t for i, _, t in rows]) > 0.98
    found = toxicity.offending_sentences(docs, model).collect()
    assert found and np.mean(["zork" in r.sentence for r in found]) > 0.95
    by = {r[0]: r[1].encode() for r in rows}
    assert all(by[r.doc_id][r.begin : r.end].decode() == r.sentence for r in found)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i in got if got[i].score < 0.7}


def test_classifiers_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 0), (4, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for module, keep in ((toxicity, toxicity.keep_clean), (quality, quality.keep_good)):
        model = module.train(awkward, labels)
        rows = module.score(awkward, model).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        assert keep(awkward, model).columns == awkward.columns
        assert module.score(nothing, model).count() == 0
        blank = module.train(awkward, labels.limit(0))
        assert module.score(awkward, blank).count() == awkward.count()


def test_training_bounds_hold_for_repeated_ids(spark, monkeypatch):
    """Three thousand rows of one id are one document of the training sample."""
    rows = [(1, f"text number {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, f=quality.fit: seen.append(len(y)) or f(x, y))
    monkeypatch.setattr(toxicity, "fit", lambda w, b, r, y, f=toxicity.fit: seen.append(len(y)) or f(w, b, r, y))
    quality.train(docs, labels, max_train=10)
    toxicity.train(docs, labels, max_train=10)
    quality.train(docs, labels)
    assert seen[:2] == [10, 10] and 10 < seen[2] <= 29


def test_document_scores_are_the_noisy_or_of_sentences(spark):
    """A plain model from the fitted weights: distinct words and stems of a sentence, logistic, noisy-or."""
    from readloom.llm.common import range_hashes

    rng = random.Random(9)
    rows = [(i, _bag(rng, i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], 1, int(r[2])) for r in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    place = lambda w: int(range_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) & (1 << toxicity.BITS) - 1
    for i, text, _ in rows:
        none, worst = 1.0, 0.0
        for sentence in text.split("."):
            words = sentence.split()
            if not words:
                continue
            parts = {place(x) for w in words for x in [w, *(w[:n] for n in toxicity.STEMS if len(w) > n)]}
            p = 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[k]) for k in parts))))
            none, worst = none * (1 - p), max(worst, p)
        assert got[i].score == pytest.approx(1 - none, abs=1e-6) and got[i].worst_score == pytest.approx(worst, abs=1e-6)


def test_pair_loss_and_quantile_cut():
    """The fitted scores lower the mean logistic loss of all pairs, and the cut leaves the share labelled 0 below it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=400) * 0.3 > 0.4).astype(int)
    model = quality.fit(x, y)
    plain = [sum(model.weights[k][int((model.edges[k] <= row[k]).sum())] for k in range(len(row))) for row in x]
    assert model.rank(x) == pytest.approx(plain)
    s = np.array(plain)
    loss = np.log1p(np.exp(-(s[y == 1][:, None] - s[y == 0][None]))).mean()
    assert loss < 0.3 < math.log(2) and model.cut == pytest.approx(np.quantile(s, np.mean(y == 0)))
    assert ((model.score(x) >= quality.CUT) == (s >= model.cut - 1e-12)).mean() > 0.99


def test_quality_learns_from_every_labelled_row(spark):
    """More rows than are fitted on the driver: edges, weights and cut are those of all rows, in any order."""
    import zlib

    import pyarrow as pa

    from readloom.llm.common import buffers

    docs = spark.range(28_000, numPartitions=5).selectExpr("id AS doc_id", "concat(repeat('ab ', int(id * id % 37)), id, repeat('!', int(id * 7 % 11))) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id * doc_id % 37 + doc_id % 5 > 12) AS quality")
    model = quality.train(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    x, y = quality.features(*buffers(pa.array([r.text for r in rows]))), np.array([r.quality for r in rows])
    assert len(rows) > quality.HERE >= 20_000
    assert model.edges == pytest.approx(np.quantile(x, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0).T, rel=1e-15)
    assert model.cut == pytest.approx(np.quantile(model.rank(x), np.mean(y == 0)))
    order = np.random.default_rng(1).permutation(len(y))
    here = quality.fit(x[order], y[order])
    assert (here.weights == model.weights).all() and (here.edges == model.edges).all() and here.cut == model.cut


def test_pair_loss_is_that_of_every_pair():
    rng = np.random.default_rng(8)
    codes, y = rng.integers(0, quality.BINS, (300, len(quality.NAMES))).astype(np.uint8), (rng.random(300) < 0.7).astype(int)
    for scale in (0.0, 0.1, 1.0, 30.0):
        w = rng.normal(size=len(quality.NAMES) * quality.BINS) * scale
        hot = np.zeros((300, len(w)))
        hot[np.arange(300)[:, None], np.arange(codes.shape[1]) * quality.BINS + codes] = 1
        s = hot @ w
        gap = s[y == 1][:, None] - s[y == 0][None]
        miss = 0.5 * (1 - np.tanh(gap / 2)) / gap.size
        slope = hot[y == 0].T @ miss.sum(0) - hot[y == 1].T @ miss.sum(1) + 0.01 * w
        loss = quality.PairLoss(quality.Here(codes, y), int((y == 0).sum()), int((y == 1).sum()), len(w), 0.01)
        value, at = loss.value(w)
        assert value == pytest.approx(np.logaddexp(0, -gap).mean() + 0.005 * (w @ w), rel=1e-4) and loss.slope(at) == pytest.approx(slope, abs=1e-4)


def test_text_statistics_against_a_plain_count():
    import re

    from readloom.llm.common import buffers
    import pyarrow as pa

    texts = ["Ab cd, cd! 12\nab\nab", "", "Spam SPAM spam spam", "é|# x\r\n\r\nx"]
    got = {n: c for n, c in zip(quality.NAMES, quality.features(*buffers(pa.array(texts))).T, strict=True)}
    for i, t in enumerate(texts):
        raw, w, ls = t.encode(), re.findall(r"[^\x20\x09-\x0D]+", t), re.findall(r"[^\n\r]+", t)
        size = [len(x.encode()) for x in w]
        pairs = [(None, w[0]), *zip(w, w[1:])] if w else []
        want = {
            "upper": sum(65 <= b < 91 for b in raw) / max(1, len(raw)), "digit": sum(48 <= b < 58 for b in raw) / max(1, len(raw)), "bytes": math.log1p(len(raw)), "words": math.log1p(len(w)), "mean_word": sum(size) / max(1, len(w)),
            "short": sum(n <= 3 for n in size) / max(1, len(w)), "stutter": sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w)), "distinct": len(set(w)) / max(1, len(w)), "pairs": len(set(pairs)) / max(1, len(w)),
            "lines": math.log1p(len(ls)), "distinct_lines": len(set(ls)) / max(1, len(ls)), "capital_words": sum("A" <= x[0] <= "Z" for x in w) / max(1, len(w)),
        }
        assert {k: got[k][i] for k in want} == pytest.approx(want), t


def _held_out(spark, module, label, modulus, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs, module.train(docs, labels)).join(labels, "doc_id").where(fold_of("doc_id", modulus) == held).select(label, "score").collect()
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return np.mean((s[y == 1][:, None] > s[y == 0][None]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None]))


def test_held_out_ranking(spark):
    assert _held_out(spark, toxicity, "toxic", 3, 1) > 0.85
    assert _held_out(spark, quality, "quality", 4, 2) > 0.9


def test_mixing_against_a_plain_model(awkward):
    import hashlib
    import re

    plan = mixing.plan(awkward).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(r.doc_id, r.source, size(r.text)) for r in awkward.collect()]
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:  # share again until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * total[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= above
    taken = {s: 0 for s in order}
    for r in plan:
        assert r.size >= 0 and 0 <= r.taken <= 2 * r.size and r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    spot = lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
    assert spot(3) in {spot(r.doc_id) for r in plan} and len(plan) == len(rows)


def test_training_order_is_the_order_of_the_mix(awkward, nothing):
    rows = mixing.training_order(awkward).collect()
    first = {}
    for place, r in enumerate(mixing.mix(awkward, position="at").collect()):
        first.setdefault(r.doc_id, (place, r["at"]))
    ids = [r.doc_id for r in rows]
    once = [r for r in rows if ids.count(r.doc_id) == 1 and r.doc_id in first]
    assert len(once) > 10 and all(r.first_position == pytest.approx(first[r.doc_id][1]) for r in once)
    places = sorted(r.first_place for r in rows if r.copies)
    assert len(set(places)) == len(places) and max(places) < sum(r.copies for r in rows)
    by_place = sorted((r.first_place, round(r.first_position, 9)) for r in rows if r.copies)
    assert [p for _, p in by_place] == sorted(p for _, p in by_place) and mixing.training_order(nothing).count() == 0


def test_mix_emits_copies_in_order(spark, awkward, nothing):
    out = mixing.mix(awkward, position="at")
    assert out.columns == [*awkward.columns, "at"]
    at = [r["at"] for r in out.collect()]
    assert at == sorted(at) and len(at) == mixing.plan(awkward).agg(F.sum("copies")).first()[0]
    assert mixing.mix(nothing).count() == 0 and mixing.plan(nothing).count() == 0


def test_schedules_shape_the_order(spark):
    rows = [(i, "w " * 20, "early" if i % 2 else "late") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    knots = spark.createDataFrame([("early", [(0.0, 2.0), (0.5, 0.0), (1.0, 0.0)]), ("late", [(0.0, 0.0), (0.5, 0.0), (1.0, 2.0)])], "source string, knots array<struct<t: double, w: double>>")
    out = [(r.source, r["at"]) for r in mixing.mix(docs, knots, position="at").collect()]
    assert all(p <= 0.5 for s, p in out if s == "early") and all(p >= 0.5 for s, p in out if s == "late")
    # Half of a falling wedge's area has passed at 1 - sqrt(1/2) of its length.
    early = sorted(p for s, p in out if s == "early")
    assert early[len(early) // 2] == pytest.approx(0.5 * (1 - math.sqrt(0.5)), abs=0.01)
