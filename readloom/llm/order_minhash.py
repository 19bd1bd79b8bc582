"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text is a sequence of units: runs of characters other than white space, each Han, kana or Thai character standing
alone. Its k-mers are runs of ``K`` units (a shorter text is one k-mer), numbered by occurrence, so a repeated k-mer
counts as often as it stands there. Each of ``FUNCTIONS`` hash orders selects the ``L`` minimal numbered k-mers; these
are put back into text order, and the hash of that tuple of k-mers is one value of the signature. Two texts agree in a
value when they share the selected k-mers and their order, which falls with edit distance and not with set overlap only.

Every order ranks all numbered k-mers of the text. The orders come in ``FAMILIES``: each has a hash of its own, and an
order compares these hashes after flipping some of their leading bits (an exclusive or by its number), which makes every
order uniformly random. One sort for each family then serves all its orders: whatever the flip, an order's L minima are
among the L first of each leading-bit range, so no order looks at the rest again. Orders of a family pick from different
ranges, so in texts of a few k-mers they are less independent than hashes apart would be; the mean is the same.

A fingerprint is the signature as text, eight hex digits a value; likeness is the share of equal values.

The next document (in descending doc_id) is found by range-sorting ids alone: the ids of a range see their successor by
a window in the range, the last one the head of the next range. Texts travel once, the heads that edits need once more.

Defined results: a null text counts as empty; empty texts have equal fingerprints; equal texts have equal fingerprints;
rows that repeat as a whole are one document in the order, each gets its row; equal ids are ordered by text hash;
a null id comes last; a single document is its own next one; an empty table gives no rows. Extra columns are ignored.
Places take 26 bits: in a text of over 67 million units the order of k-mers further apart than that is arbitrary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import durable, table, text_or_empty

K = 3
L = 2
FUNCTIONS = 32
FAMILIES = 2
#: Thai, Han and its radicals, marks and numerals, and kana, as code-point ranges: scripts tested by name cost far more
_ALONE = r"\u0E01-\u0E3A\u0E40-\u0E5B\u2E80-\u2FDF\u3005\u3007\u3021-\u3029\u3038-\u303B\u3041-\u3096\u309D-\u309F\u30A1-\u30FA\u30FD-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF6F\uFF71-\uFF9D\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}"
#: one unit: a character that stands alone, or a run of others
UNIT = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]+"
_PLACE = (1 << 26) - 1
_BITS = (FUNCTIONS // FAMILIES).bit_length() - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    """The units of a text; where none stands alone they are what white space leaves."""
    return F.when(text.rlike(f"[{_ALONE}]"), F.regexp_extract_all(text, F.lit(UNIT), 0)).otherwise(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))


def _hash(e: Column) -> Column:
    return e.bitwiseAND(~_PLACE)


def _place(e: Column) -> Column:
    return e.bitwiseAND(_PLACE)


def _numbered(later: Column) -> Column:
    """Names of k-mers that occurred before: their hash with their number, from sorted longs without the first ones."""

    def of(starts: Column) -> Column:
        # Occurrences of a k-mer are neighbours: runs of equal hashes keep this linear in the text.
        run = lambda i, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), F.size(later)) - i - 1)
        return F.flatten(F.transform(starts, lambda i, j: F.transform(run(i, j), lambda k: _hash(F.xxhash64(_hash(F.get(later, i)), k + 2)).bitwiseOR(_place(F.get(later, i + k))))))

    new = F.transform(later, lambda e, i: F.when((i == 0) | (_hash(F.get(later, i - 1)) != _hash(e)), i))
    return let(F.filter(new, lambda i: i.isNotNull()), of)


def _family(names: Column, k: int) -> Column:
    """The names under the hash of another family."""
    return F.transform(names, lambda e: _hash(F.xxhash64(_hash(e), F.lit(k))).bitwiseOR(_place(e)))


def _heads(names: Column) -> Column:
    """The L first of each leading-bit range of sorted names."""
    range_ = lambda e: F.shiftrightunsigned(e, 64 - _BITS)
    return F.filter(names, lambda e, i: (i < L) | (range_(F.get(names, i - L)) != range_(e)))


def with_signature(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with FUNCTIONS hashes of the text column in a column of that name.

    Step by step, so that every array is computed once and sorted by generated code. An array holds 38 bits of a hash
    and 26 of a place in each long.
    """
    kept, c = [F.col(x) for x in rows.columns], F.col
    u = c("__u")
    kmers = F.transform(u, lambda x, i: _hash(F.xxhash64(x, F.get(u, i + 1), F.get(u, i + 2))).bitwiseOR(_place(i.cast("long"))))
    rows = rows.select(*kept, units(c(text)).alias("__u"))
    rows = rows.select(*kept, F.slice(kmers, 1, F.greatest(F.lit(1), F.size(u) - K + 1)).alias("__k"))
    rows = rows.select(*kept, "__k", F.sort_array("__k").alias("__s"))
    s = c("__s")
    new = lambda e, i: (i == 0) | (_hash(F.get(s, i - 1)) != _hash(e))
    rows = rows.select(*kept, "__k", F.filter(s, new).alias("__first"), F.filter(s, lambda e, i: ~new(e, i)).alias("__later"))
    rows = rows.select(*kept, "__k", F.when(F.size("__later") == 0, c("__first")).otherwise(F.sort_array(F.concat("__first", _numbered(c("__later"))))).alias("__0"))
    apart = [F.sort_array(_family(c("__0"), k)).alias(f"__{k}") for k in range(1, FAMILIES)]
    rows = rows.select(*kept, "__k", "__0", *apart)
    def value(heads: Column, k: int, flip: Column) -> Column:
        mask = F.shiftleft(flip.cast("long"), 64 - _BITS)
        least = F.slice(F.sort_array(F.transform(heads, lambda e: e.bitwiseXOR(mask))), 1, L)
        places = F.sort_array(F.transform(least, _place))
        return F.xxhash64(F.transform(places, lambda p: _hash(F.get(c("__k"), p.cast("int")))), F.lit(k), flip)

    flips = F.sequence(F.lit(0), F.lit((1 << _BITS) - 1))
    of_family = lambda k: let(_heads(c(f"__{k}")), lambda heads: F.transform(flips, lambda flip: value(heads, k, flip)))
    values = [of_family(k) for k in range(FAMILIES)]
    return rows.select(*kept, F.concat(*values).alias(name))


def as_text(signature_: Column) -> Column:
    return F.array_join(F.transform(signature_, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.bitwiseAND(0xFFFFFFFF) == y.bitwiseAND(0xFFFFFFFF)), lambda same: same)) / F.lit(float(FUNCTIONS))


KEY = ["id_text", "id_null", "hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with three columns without nulls that tell documents apart."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.withColumns({"id_text": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "id_null": F.col("doc_id").isNull(), "hash": F.xxhash64("text")})


def _named(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in KEY]


def _on(prefix: str) -> Column:
    same = [F.col(c) == F.col(f"{prefix}_{c}") for c in KEY]
    return same[0] & same[1] & same[2]


def signatures(docs: DataFrame) -> DataFrame:
    """One row a distinct document: its key, doc_id, length and signature."""
    rows = with_signature(_keyed(docs).select(*KEY, "doc_id", F.length("text").cast("long").alias("n"), "text"), "text", "signature")
    rows = rows.withColumn("signature", F.transform("signature", lambda v: v.bitwiseAND(0xFFFFFFFF)))
    return rows.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("doc_id", "n", "signature")])


def successors(signed: DataFrame) -> DataFrame:
    """key, length and the key of the next document (next_...) in descending doc_id."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").desc()]
    # Written once, so that the ranges below are the same for both readings.
    rows = durable(signed.select(*KEY, "doc_id", "n").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "omh-order")
    inside, here = Window.partitionBy("range").orderBy(*order), F.struct(*KEY)
    rows = rows.withColumns({"next": F.lead(here).over(inside), "first": F.row_number().over(inside) == 1})
    # One row a range: as many as the sort had tasks.
    ring = Window.orderBy("range")
    start = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = rows.where("first").select("range", here.alias("head"))
    heads = heads.select("range", F.coalesce(F.lead("head").over(ring), start).alias("head"))
    rows = rows.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "head"))
    return rows.select(*KEY, "n", *[F.col(f"next.{c}").alias(f"next_{c}") for c in KEY])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and next_id of every row."""
    signed = durable(signatures(docs), "omh-signatures")
    follow = durable(successors(signed), "omh-next")
    texts = _keyed(docs)
    # What each document hands to the one before it: the head that the edit takes.
    asked = follow.select(*_named("of"), *[F.col(f"next_{c}").alias(f"to_{c}") for c in KEY], F.floor(F.col("n") / 3).cast("int").alias("cut"))
    # With doc_id, both joins below read the same columns of ``texts``, so its exchange is made once and reused.
    heads = texts.join(asked, _on("to")).select(*[f"of_{c}" for c in KEY], F.col("text").substr(F.lit(1), F.col("cut")).alias("head"), F.col("doc_id").alias("next_id"))
    heads = heads.groupBy(*[f"of_{c}" for c in KEY]).agg(F.first("head").alias("head"), F.first("next_id").alias("next_id"))
    after = follow.select(*_named("own"), *[F.col(f"next_{c}").alias(c) for c in KEY]).join(signed.select(*KEY, F.col("signature").alias("next_signature")), KEY).drop(*KEY)
    both = signed.select(*KEY, "n", "signature").join(after, _on("own")).select(*_named("at"), "n", "signature", "next_signature")
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 3).cast("int")), "head")
    rows = with_signature(texts.join(heads, _on("of")).select("doc_id", "next_id", *KEY, edited.alias("edited")), "edited", "edited_signature")
    rows = rows.select("doc_id", "next_id", *KEY, F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), "edited_signature")
    rows = rows.join(both, _on("at"))
    return rows.select(
        "doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"), "next_id",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
