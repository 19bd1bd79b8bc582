import random

import pytest


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(6)]
    lines = "\n".join(words(rng, 6) for _ in range(8))
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10, base[0], "en", "s0"), (11, base[0] + " tail", None, None), (12, lines, "fr", "s1"), (13, "x\n" + lines, "fr", "s1"), (14, "", "en", "s2"), (15, None, None, None), (None, base[1], "en", None)]
    rows += [(16, words(rng, 30_000), "en", "s2"), (17, "z" * 20_000, "en", "s2"), (18, "spam " * 5000, "en", "s2"), (19, "é 漢字 ▁ \x00\n\n\n\n\n\n", "xx", "é")]
    rows += [(3, base[3], "en", "s0")] * 2 + [(20, "  \n\t ", "en", "s1"), (21, "one", "en", "s1"), (22, "one", "en", "s1")]
    full = [(*r, len(r[1] or ""), 7, 0.5, "x", r[0], "k") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, score double, hash string, id long, class string").coalesce(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
