"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines are hashed (128 bits). A window that stands anywhere else before, in the order of
document id, text hash and line number, is a repeat; the lines that any repeat of a document covers are taken out, and
the rest is joined again. The first occurrence of each window stays where it is, unless another repeat covers a part of
it (the covered lines then stand in an earlier document still, or earlier in the same text).

Windows are counted by partial aggregation, only windows that occur more than once are joined back, and a document's
covered lines are a set difference of line numbers, so neither a passage that everyone shares nor a text of very many
lines makes more than linear work.

Defined results: null texts stay null; texts of fewer than three lines are unchanged; windows of three blank lines
count for nothing; rows that repeat as a whole (same id, same text) are one document and keep the same lines; a text
all of whose lines go becomes empty, its row stays; an empty table gives an empty table. ``n_chars``, where present, is
the new length. Extra columns pass through :func:`drop_repeated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import durable, table

SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text_hash, line, h1, h2: one row for each window of ``span`` lines that isn't blank."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    rows = rows.where(F.size("lines") >= span)
    at = lambda i: [F.element_at("lines", i + k) for k in range(span)]
    found = F.transform(
        F.sequence(F.lit(1), F.size("lines") - span + 1),
        lambda i: F.struct((i - 1).alias("line"), F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit("readloom"), *at(i)).alias("h2"), F.concat(*at(i)).rlike(r"[^\x20\x09-\x0D]").alias("said")),
    )
    rows = rows.select("doc_id", "text_hash", F.explode(found).alias("w"))
    return rows.where("w.said").select("doc_id", "text_hash", "w.line", "w.h1", "w.h2")


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text_hash and the first lines of its windows that stand earlier elsewhere."""
    found = durable(windows(docs, span), "line-windows")
    place = F.struct("doc_id", "text_hash", "line")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join's two sides are plain exchanges, whose hot windows Spark can split.
    first = durable(first, "line-firsts")
    later = found.join(first, ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("starts"))


def _with_kept(docs: DataFrame, span: int) -> DataFrame:
    """All rows and columns, with ``__lines`` and ``__kept``, the numbers of the lines that stay."""
    gone = repeats(docs, span).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("starts").alias("__starts"))
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")) & F.col("text").isNotNull(), "left")
    lines = _lines(F.col("text"))
    covered = F.flatten(F.transform("__starts", lambda s: F.array(*[s + k for k in range(span)])))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    return rows.withColumns({"__lines": lines, "__kept": F.when(F.col("__starts").isNotNull(), F.array_except(every, covered))})


def drop_repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The same rows and columns, texts without their repeated lines."""
    rows = _with_kept(docs, span)
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__kept", lambda i: F.element_at("__lines", i + 1)), "\n"))
    rows = rows.withColumn("__text", text)
    length = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__text")) if "n_chars" in docs.columns else None
    kind = dict(docs.dtypes)
    return rows.select(*[F.col("__text").alias("text") if c == "text" else length.cast(kind[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _with_kept(docs, SPAN)
    kept = F.transform("__kept", lambda i: F.element_at("__lines", i + 1))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines"))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(n - F.size("__kept"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated(docs)


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(w, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.l), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""
