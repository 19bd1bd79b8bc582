"""Mixing sources by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, given by (t, weight) knots joined by straight lines. The
integral of its schedule is its share of the budget; the running integral, scaled to its target, says how many of its
words are wanted by time t. A document's words stand at a place in that demand, in the order of its id's md5; inverting
the demand at the middle of its words gives the document's training position, and the mix is range-sorted by position.

Targets: each source gets budget * share, but no more than ``most`` times its size; what is above is shared again by
weight among the others until none is above (solved at once, by sources in ascending order of cap per weight). A
source's first pass takes its documents in order, a second pass repeats them, and the last document of a pass may be
taken in part; so the taken words of a source add up to its target, rounded to words.

Running sums inside a source have three levels: over groups of hash buckets, over the buckets of a group, and inside a
bucket, so a source with most of the rows is spread over as many tasks as it has buckets, and no task sums all buckets.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, ranked last; repeated rows
each count; a tie in md5 order (equal ids) goes by text hash; an empty table gives an empty plan. Extra columns are
ignored by :func:`plan` and carried along by :func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import durable, table

BUDGET = 1.5
MOST = 2.0
#: weights of the sources in code-point order, repeating
WEIGHTS = (3.0, 1.0, 2.0)
#: how a weight leans from the start to the end of training, in the same order: early, level, late
LEANS = (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_BUCKET = 4000


def _measured(docs: DataFrame, bucket_digits: int | None = None, whole: bool = False) -> DataFrame:
    """What the plan needs of a document, in a small row; with ``whole`` the document's columns too, as the struct row."""
    digits = bucket_digits or max(2, math.ceil(math.log(max(1, docs.count()) / ROWS_A_BUCKET, 16)))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
        F.xxhash64("text").alias("text_hash"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("spot"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []),
    )
    return rows.withColumn("bucket", F.substring("spot", 1, digits))


def default_schedules(sources: DataFrame) -> DataFrame:
    """source, rank and knots: the weights 3, 1, 2 by source order, leaning early, level and late in turn."""
    at = F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), at + 1)
    lean = F.element_at(F.array(*map(F.lit, LEANS)), at + 1)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    return ranked.withColumn("knots", F.array(knot(0.0, weight * (1 - lean)), knot(1.0, weight * (1 + lean))))


def _segments(knots: Column) -> Column:
    """The straight pieces of a schedule with their areas and the area before each."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("dt"),
            F.element_at(knots, i)["w"].alias("w"),
            (F.element_at(knots, i + 1)["w"] - F.element_at(knots, i)["w"]).alias("dw"),
        ),
    )
    area = lambda p: (p["w"] + p["dw"] / 2) * p["dt"]
    before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0.0), lambda s, p: s + area(p))
    return F.transform(pieces, lambda p, i: F.struct(p["t"].alias("t"), p["dt"].alias("dt"), p["w"].alias("w"), p["dw"].alias("dw"), area(p).alias("area"), before(i).alias("before")))


def _invert(segments: Column, total: Column, share: Column) -> Column:
    """The time by which ``share`` of a schedule's whole area has passed."""
    want = share * total
    last = F.element_at(F.filter(segments, lambda p: (p["before"] <= want) | (p["before"] == 0)), -1)
    # (w + dw x / 2) dt x = want - before, for x in 0..1, in the form that is safe for dw = 0
    rest = F.greatest(F.lit(0.0), want - last["before"]) / last["dt"]
    root = F.sqrt(F.greatest(F.lit(0.0), last["w"] * last["w"] + 2 * last["dw"] * rest))
    x = F.when(last["w"] + root > 0, 2 * rest / (last["w"] + root)).otherwise(0.0)
    return last["t"] + F.least(F.lit(1.0), x) * last["dt"]


def targets(sizes: DataFrame, schedules: DataFrame | None = None, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """One row a source: its words, target and schedule. Single-partition windows here see one row a source only."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if schedules is None:
        known = default_schedules(sources)
    else:
        known = sources.join(schedules.select("source", "knots"), sources["source"].eqNullSafe(schedules["source"])).drop(schedules["source"])
        known = known.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    known = known.withColumn("segments", _segments(F.col("knots")))
    known = known.withColumn("weight", F.aggregate("segments", F.lit(0.0), lambda s, p: s + p["area"]))
    by_cap = Window.orderBy("per_weight", "rank")
    known = known.withColumn("cap", most * F.col("source_size")).withColumn("per_weight", F.col("cap") / F.col("weight"))
    used = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (budget * F.sum("source_size").over(Window.partitionBy()) - used) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    known = known.withColumn("level", level)
    found = F.first(F.when(F.col("per_weight") > F.col("level"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.select("source", "source_size", F.least("cap", F.coalesce(found * F.col("weight"), F.col("cap"))).alias("target"), "segments", F.col("weight").alias("area"))


def _bucket_starts(sums: DataFrame) -> DataFrame:
    """The words of a source before each of its buckets: over groups of buckets, then inside a group."""
    group = F.expr("substring(bucket, 1, length(bucket) div 2)")
    sums = sums.withColumn("group", group)
    groups = sums.groupBy("key", "group").agg(F.sum("size").alias("words"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("group_start", F.coalesce(F.sum("words").over(before("key").orderBy("group")), F.lit(0))).drop("words")
    inside = F.coalesce(F.sum("size").over(before("key", "group").orderBy("bucket")), F.lit(0))
    placed = sums.withColumn("inside", inside).join(groups, ["key", "group"])
    return placed.select("key", "bucket", (F.col("group_start") + F.col("inside")).alias("bucket_start"))


def _placed(rows: DataFrame, schedules: DataFrame | None, budget: float, most: float) -> DataFrame:
    """Measured rows with source_size, target, taken, copies and positions; they are exchanged once, by source and bucket."""
    # Null sources meet under a key of their own.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sums = durable(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")).withColumn("key", key), "mix-buckets")
    known = targets(sums, schedules, budget, most).withColumn("key", key).drop("source")
    placed = rows.withColumn("key", key).join(_bucket_starts(sums).join(known, "key"), ["key", "bucket"])
    inside = Window.partitionBy("key", "bucket").orderBy("spot", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("begin", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.round("target").cast("long")
    begin = lambda p: F.col("begin") + p.cast("long") * F.col("source_size")
    passes = F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))
    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda s, p: s + F.greatest(F.lit(0), F.least(F.col("size"), whole - begin(p))))
    middle = lambda p: begin(p) + F.col("size") / 2
    positions = F.transform(F.filter(passes, lambda p: middle(p) < F.col("target")), lambda p: _invert(F.col("segments"), F.col("area"), middle(p) / F.col("target")))
    return placed.withColumns({"taken": taken, "copies": F.size(positions), "positions": positions})


def plan(docs: DataFrame, schedules: DataFrame | None = None, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """One row a document: size, source_size, target, taken words, whole copies and the copies' positions (0..1)."""
    placed = _placed(durable(_measured(docs), "mix-sizes"), schedules, budget, most)
    return placed.select("doc_id", "source", "spot", "text_hash", "size", "source_size", "target", "taken", "copies", "positions")


def mix(docs: DataFrame, schedules: DataFrame | None = None, budget: float = BUDGET, most: float = MOST, position: str | None = None) -> DataFrame:
    """The training order: every taken document once a copy, in ascending position (a column of that name if given).

    Whole documents are emitted: a copy is kept when the middle of its words lies inside the target. Rows travel whole
    to their bucket, so repeated rows need no matching with their plan; they are exchanged once more, for the order.
    """
    chosen = _placed(_measured(docs, whole=True), schedules, budget, most)
    copies = chosen.select("doc_id", "row", F.explode("positions").alias("position"))
    out = copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *([F.col("position").alias(position)] if position else []))


def training_order(docs: DataFrame, schedules: DataFrame | None = None, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """The plan with each document's first_position and first_place: its first copy's time and place in the training order.

    The order is that of :func:`mix`: copies are range-sorted by position (rounded to 9 digits; then by md5 and id), and
    a copy's place is the count of copies before it. Both are null for a document without copies.
    """
    rows = durable(plan(docs, schedules, budget, most).withColumn("row", F.monotonically_increasing_id()), "mix-plan")
    copies = rows.select("row", "doc_id", "text_hash", "spot", F.posexplode("positions").alias("nth", "position"))
    order = [F.round("position", 9), F.col("spot"), F.col("doc_id"), F.col("nth"), F.col("text_hash"), F.col("row")]
    # Written once, so that ranges are the same for both readings below.
    copies = durable(copies.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-order")
    # One row a range: as many as the sort had tasks.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(*order)
    placed = copies.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.row_number().over(inside) - 1)
    first = placed.groupBy("row").agg(F.min("place").alias("first_place"), F.min("position").alias("first_position"))
    return rows.join(first, "row", "left").drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = training_order(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "copies", F.round("first_position", 6).alias("first_position"), "first_place")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS spot FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM d GROUP BY source),
c AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS per_weight, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, weight, CASE (rnk - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS lean, least(cap, coalesce((SELECT arg_min(level, per_weight) FROM l WHERE per_weight > level) * weight, cap)) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, spot, weight, weight * (1 - lean) AS w, weight * (1 + lean) - weight * (1 - lean) AS dw, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT doc_id, spot, nth, w, dw, (b + nth * source_size + size / 2) / target * ((w + dw / 2) * 1.0::DOUBLE) AS want FROM p, (VALUES (0), (1)) AS n(nth) WHERE b + nth * source_size + size / 2 < target),
o AS (SELECT doc_id, nth, least(1.0::DOUBLE, CASE WHEN w + sqrt(w * w + 2 * dw * want) > 0 THEN 2 * want / (w + sqrt(w * w + 2 * dw * want)) ELSE 0 END) AS position, spot FROM k),
r AS (SELECT doc_id, position, row_number() OVER (ORDER BY round(position, 9), spot, doc_id, nth) - 1 AS place FROM o),
f AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS copies, round(min(position), 6) AS first_position, min(place) AS first_place FROM r GROUP BY doc_id)
SELECT p.doc_id, size, source_size, round(target, 4) AS target, CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - b)) + greatest(0, least(size, CAST(round(target) AS BIGINT) - b - source_size)) AS BIGINT) AS taken, coalesce(copies, 0) AS copies, first_position, first_place FROM p LEFT JOIN f USING (doc_id)
"""
