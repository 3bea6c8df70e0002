"""Orderings, scans, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from maskmix.functions.arrays import mask_text
from maskmix.operators.masks import change_flags, distinct_masks, sample_masks, with_mask
from maskmix.operators.selection import apply_deletion, class_penalty, class_summary, conclude
from maskmix.plans.fit import choose_subset
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.joins import ARRIVALS, STARTS
from maskmix.queries.projections import SUBSET
from maskmix.queries.registry import query
from maskmix.sources.rows import join_small, number_sorted
from maskmix.sources.sinks import mask_order

RANKED = "ranked AS (SELECT point_id, mask, row_number() OVER (ORDER BY mask, point_id) - 1 AS rank FROM masks)"


def mask_index(masked: DataFrame, workspace) -> DataFrame:
    """``point_id, mask_index``: how many distinct masks come before a point's own.

    Points are range-partitioned by (mask, point), so a mask of very many points lies in many pieces.
    Changes of mask are counted inside each piece; the counts before it (one row per piece) are added.
    """
    ranged = masked.select("mask", "point_id").repartitionByRange("mask", "point_id")
    stored = workspace.save(ranged.withColumn("piece", F.spark_partition_id()), "ranged")
    order = Window.partitionBy("piece").orderBy("mask", "point_id")
    changed = F.when(F.lag("mask").over(order) != F.col("mask"), 1).otherwise(0)
    inside = F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = stored.withColumn("changed", changed).withColumn("inside", inside).drop("changed")
    ends = stored.groupBy("piece").agg(F.min("mask").alias("low"), F.max("mask").alias("high"), F.countDistinct("mask").alias("n"))
    pieces = Window.orderBy("piece")
    new = F.when(F.lag("high").over(pieces) == F.col("low"), 0).otherwise(1)  # the first mask may go on from before
    ends = ends.withColumn("new", new).withColumn("upto", F.sum(F.col("n") - 1 + F.col("new")).over(pieces))
    firsts = ends.select("piece", (F.col("upto") - F.col("n")).alias("first"))
    return join_small(counted, firsts, "piece").select("point_id", (F.col("first") + F.col("inside")).alias("mask_index"))


@query("wn1_mask_order", S.with_(S.CELLS, S.MASKS, RANKED) + "SELECT point_id, mask, rank FROM ranked")
def mask_sort(spark, sf):
    ranked = mask_order(Q.embedding_points(spark, sf), Q.workspace(spark, "order"))
    return ranked.select("point_id", mask_text(F.col("mask")).alias("mask"), "rank")


@query(
    "wn2_mask_change_flag",
    S.with_(S.CELLS, S.MASKS)
    + """SELECT point_id, CASE WHEN before = mask THEN 0 ELSE 1 END AS changed FROM (
  SELECT point_id, mask, lag(mask) OVER (ORDER BY mask, point_id) AS before FROM masks) m""",
)
def mask_change_flag(spark, sf):
    return change_flags(with_mask(Q.embedding_points(spark, sf))).select("point_id", "changed")


@query(
    "wn3_running_mask_index",
    S.with_(S.CELLS, S.MASKS) + "SELECT point_id, dense_rank() OVER (ORDER BY mask) - 1 AS mask_index FROM masks",
)
def running_mask_index(spark, sf):
    masked = with_mask(Q.embedding_points(spark, sf))
    return mask_index(masked, Q.workspace(spark, "index")).select("point_id", "mask_index")


@query(
    "wn4_best_two_classes",
    S.with_(*S.STEP)
    + f"""SELECT point_id, old_class, CAST(class AS INTEGER) AS class, CAST(class2 AS INTEGER) AS class2,
    {S.r6('nlp')} AS nlp, {S.r6('nlp2')} AS nlp2 FROM assigned""",
)
def best_two_classes(spark, sf):
    assigned, _, _ = Q.diagonal_assignment(spark, sf)
    return assigned.select(
        "point_id", "old_class", "class", "class2", Q.r6(F.col("nlp")).alias("nlp"), Q.r6(F.col("nlp2")).alias("nlp2")
    )


@query(
    "wn5_deletion_candidate",
    S.with_(*S.STEP, S.SUMMARY, S.POINTS, S.CANDIDATE)
    + f"SELECT CAST(class AS INTEGER) AS class, {S.r6('delta', 4)} AS delta FROM candidate",
)
def deletion_candidate(spark, sf):
    assigned, _, n = Q.diagonal_assignment(spark, sf)
    per_param = class_penalty(1.0, n, Q.DIAGONAL)
    delta = F.col("loss") - F.col("params") * F.lit(per_param)
    rows = class_summary(assigned).where("class <> 0").select("class", delta.alias("delta"))
    return rows.orderBy("delta", "class").limit(1).select("class", Q.r6(F.col("delta"), 4).alias("delta"))


@query("wn6_reassign_on_deletion", S.with_(*S.DELETION) + "SELECT point_id, CAST(class AS INTEGER) AS class FROM after")
def reassign_on_deletion(spark, sf):
    assigned, model, n = Q.diagonal_assignment(spark, sf)
    assigned = Q.workspace(spark, "reassign").save(assigned, "assigned")
    outcome = conclude(assigned, set(model.counts), n, Q.DIAGONAL)
    return apply_deletion(assigned, outcome.deleted).select("point_id", "class")


@query(
    "wn7_alive_index",
    """SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS alive_index FROM (
  SELECT label * 3 AS class FROM embeddings GROUP BY label UNION SELECT 0) c""",
)
def alive_index(spark, sf):
    """Dense places of the classes in use, noise first; one row per class."""
    used = Q.embedding_points(spark, sf).select((F.col("class") * 3).alias("class")).distinct()
    alive = used.union(spark.range(1).select(F.lit(0))).distinct()
    return alive.select("class", (F.row_number().over(Window.orderBy("class")) - 1).alias("alive_index"))


BLOCK = 65536  # rows of a block, and blocks of a group of blocks


@query(
    "wn8_inclusive_scan",
    f"SELECT event_id, {S.r6('sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)', 2)} AS running FROM events",
)
def inclusive_scan(spark, sf):
    """Running sum by blocks of consecutive ids: scan inside each block, add the totals before it."""
    events = Q.table(spark, sf, "events").select("event_id", "value")
    blocked = events.withColumn("block", F.floor(F.col("event_id") / BLOCK))
    inside = Window.partitionBy("block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy("block").agg(F.sum("value").alias("total")).withColumn("outer", F.floor(F.col("block") / BLOCK))
    before = Window.partitionBy("outer").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer_before = Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1)  # a row per 2^32 events
    outer = totals.groupBy("outer").agg(F.sum("total").alias("sum"))
    outer = outer.select("outer", F.coalesce(F.sum("sum").over(outer_before), F.lit(0.0)).alias("earlier"))
    inner = totals.select("outer", "block", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("near"))
    offsets = inner.join(outer, "outer").select("block", (F.col("near") + F.col("earlier")).alias("offset"))
    scanned = join_small(blocked.withColumn("inside", F.sum("value").over(inside)), offsets, "block")
    return scanned.select("event_id", Q.r6(F.col("inside") + F.col("offset"), 2).alias("running"))


@query(
    "wn9_compaction",
    """SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'error'""",
)
def compaction(spark, sf):
    """Flagged rows moved together in order."""
    flagged = Q.table(spark, sf, "events").where("event_type = 'error'").select("event_id")
    return number_sorted(flagged, ["event_id"], "place", Q.workspace(spark, "compaction"))


@query(
    "wn10_first_unused_id",
    """SELECT CAST(min(c) AS BIGINT) AS unused FROM (SELECT unnest(range(1, (SELECT max(label) + 2 FROM embeddings))) AS c) r
  WHERE c NOT IN (SELECT label FROM embeddings)""",
)
def first_unused_id(spark, sf):
    """The smallest id from 1 on that no class has: 1, or the one after a class whose successor is free."""
    used = Q.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("id")).where("id >= 0").distinct()
    after = used.union(spark.range(1)).distinct().select((F.col("id") + 1).alias("id"))
    return after.join(used, "id", "left_anti").agg(F.min("id").alias("unused"))


@query("wn11_systematic_sample", S.with_(SUBSET) + "SELECT point_id FROM chosen")
def systematic_sample(spark, sf):
    return choose_subset(Q.embedding_points(spark, sf), 4, 1, Q.workspace(spark, "sample"))


@query(
    "wn12_weighted_mask_sample",
    S.with_(S.CELLS, S.MASKS, ARRIVALS)
    + f"SELECT mask, n, {S.r6('arrival')} AS arrival FROM arrivals ORDER BY arrivals.arrival, first_point LIMIT {STARTS}",
)
def weighted_mask_sample(spark, sf):
    masks = sample_masks(distinct_masks(with_mask(Q.embedding_points(spark, sf))), STARTS, 1)
    return masks.select(mask_text(F.col("mask")).alias("mask"), "n", Q.r6(F.col("arrival")).alias("arrival"))
