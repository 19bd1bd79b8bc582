"""Column functions over sequencing reads: bases, qualities, headers and the overlap of a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quality cut-offs as raw ASCII, the Phred offset, and the overlap search's limits.
Q20, Q30, Q40 = 53, 63, 73
PHRED_OFFSET = 33
OVERLAP_DIFF_LIMIT, OVERLAP_LEAST, OVERLAP_DIFF_SHARE = 5, 30, 0.20

# Header patterns of the four platforms, in the order in which ties are broken (the last wins).
PLATFORMS = {
    "Illumina": r"^@[^:\s]+:\d+:[^:\s]+:\d+:\d+:\d+:\d+(?:\s+[12]:[YN]:\d+:[A-Za-z0-9+_-]+)?\z",
    "BGI/MGI": r"^@(?:V\d+|CL\d+|E\d+|MGI|DNBSEQ|BGI)[A-Za-z0-9_-]*(?:[/:#\s].*)?\z",
    "PacBio": r"^@[^/\s]+/\d+/\d+_\d+(?:\s.*)?\z",
    "Oxford Nanopore": r"^@[A-Za-z0-9-]+(?:\s+\S+=\S+)*\s+runid=[0-9a-fA-F-]+(?:\s+\S+=\S+)*\s+ch=\d+(?:\s+\S+=\S+)*\s+start_time=\S+",
}

_PRINTABLE = "".join(map(chr, range(33, 127)))


def base_code(base: Column) -> Column:
    """The low three bits of a base letter: A 1, C 3, T 4, N 6, G 7; other letters fall on the same codes."""
    return F.ascii(base).bitwiseAND(7)


def letters_of(codes: tuple[int, ...]) -> str:
    """All printable characters with one of these base codes."""
    return "".join(c for c in _PRINTABLE if ord(c) & 7 in codes)


def count_of(text: Column, letters: str) -> Column:
    """How many characters of the text are among the letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def count_at_least(qualities: Column, least: int) -> Column:
    """How many quality characters are at or above a raw ASCII value."""
    return count_of(qualities, "".join(map(chr, range(least, 127))))


def phred64_to_33(qualities: Column) -> Column:
    """Shift qualities of the older offset down by 31, no lower than the offset 33."""
    return F.translate(qualities, _PRINTABLE, "".join(chr(max(ord(c) - 31, PHRED_OFFSET)) for c in _PRINTABLE))


def reverse_complement(seq: Column) -> Column:
    """Complement in the same case, reversed; anything but ACGTN becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def read_id(header: Column) -> Column:
    """The header without @, cut at the first space or tab, without a trailing /1 or /2."""
    return F.regexp_replace(F.regexp_extract(header, "^@?([^ \t]*)", 1), r"/[12]\z", "")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two texts of equal length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.size(F.filter(pairs, lambda d: d))


def phred_label(least: Column, most: Column) -> Column:
    """The quality encoding that a range of raw ASCII values points at; the first rule that holds."""
    unknown = F.concat(F.lit("Unknown (ASCII "), least.cast("string"), F.lit("-"), most.cast("string"), F.lit(")"))
    return F.when((least >= 33) & (most <= 74), "Phred33").when((least >= 64) & (most <= 104), "Phred64").when(least.isNotNull(), unknown).otherwise("No qualities observed")


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's bytes as 16 hex digits, by 32-bit halves so that no product overflows."""
    # prime 2^40 + 435, offset 0xCBF29CE484222325, fixed values of the hash
    mask = (1 << 32) - 1

    def step(state: Column, byte: Column) -> Column:
        low = state["low"].bitwiseXOR(byte)
        p = low * 435
        high = (state["high"] * 435 + F.shiftrightunsigned(p, 32) + F.shiftleft(low.bitwiseAND((1 << 24) - 1), 8)).bitwiseAND(mask)
        return F.struct(high.alias("high"), p.bitwiseAND(mask).alias("low"))

    hexed = F.hex(text.cast("binary"))
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), 1)
    bytes_ = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
    last = F.aggregate(bytes_, F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low")), step)
    return F.transform(F.array(last), lambda s: F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0")))[0]


# ---- overlap ------------------------------------------------------------------------------------


def overlap_batch(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of reads (the second already reverse-complemented): found, offset, overlap length.

    Pairs of equal lengths are laid out as one byte matrix; an offset is tried for all pairs that have none yet.
    """
    n = len(first)
    found, offset, size = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int32)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(first, second, strict=True)):
        shapes.setdefault((len(a), len(b)), []).append(i)
    for (la, lb), rows in shapes.items():
        a = np.frombuffer("".join(first[i] for i in rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), la)
        b = np.frombuffer("".join(second[i] for i in rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), lb)
        open_ = np.array(rows)
        for shift in [*range(la - OVERLAP_LEAST), *range(-1, -(lb - OVERLAP_LEAST), -1)]:
            if not len(open_):
                break
            length = min(la - shift, lb) if shift >= 0 else min(la, lb + shift)
            left, right = (a[:, shift : shift + length], b[:, :length]) if shift >= 0 else (a[:, :length], b[:, -shift : length - shift])
            hit = (left != right).sum(1) <= min(OVERLAP_DIFF_LIMIT, int(length * OVERLAP_DIFF_SHARE))
            if hit.any():
                found[open_[hit]], offset[open_[hit]], size[open_[hit]] = True, shift, length
                a, b, open_ = a[~hit], b[~hit], open_[~hit]
    return found, offset, size


_OVERLAP = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType())])


@F.pandas_udf(_OVERLAP)
def _overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in batches:
        found, offset, size = overlap_batch(a.fillna("").tolist(), b.fillna("").tolist())
        yield pd.DataFrame({"found": found, "offset": offset, "length": size})


def overlap(seq1: Column, seq2: Column) -> Column:
    """found, offset, length of the first overlap of a read with its mate's reverse complement within the limits."""
    return _overlap(seq1, reverse_complement(seq2))


def insert_size(seq1: Column, seq2: Column, found: Column, most: int) -> Column:
    """The insert size that an overlap gives, ``most`` for none or for larger ones."""
    size = F.when(~found["found"], most).when(found["offset"] > 0, F.length(seq1) + F.length(seq2) - found["length"]).otherwise(found["length"])
    return F.least(size, F.lit(most)).cast("int")
