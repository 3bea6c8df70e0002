"""Steps of the EM loop, whole fits and the search over starts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.operators.masks import start_classes
from maskmix.operators.moments import m_step, weight_column
from maskmix.operators.scoring import assign
from maskmix.operators.selection import conclude
from maskmix.plans.fit import fit, is_full_step, resume
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.functions import D, LINES
from maskmix.queries.joins import ARRIVALS, CHOSEN_MASKS, NEAREST, STARTS
from maskmix.queries.registry import query


@query(
    "it1_m_step",
    S.with_(*LINES)
    + "SELECT class, CAST(n AS BIGINT) AS n, "
    + f"{S.r6('weight', 9)} AS weight, "
    + ", ".join(f"{S.r6(f'm{i}')} AS mean{i}, {S.r6(f'k{i}{i}', 9)} AS variance{i}" for i in D)
    + f", {S.r6('log_root_det')} AS log_root_det FROM model WHERE class <> 0",
)
def m_step_model(spark, sf):
    """Sizes, weights, means, variances and determinants of the line-item classes."""
    points, noise = Q.lineitem_prepared(spark, sf)
    table = Q.workspace(spark, "model").save(m_step(points, noise, MixtureConfig()), "model")
    whole = table.agg(F.sum("n").alias("n"), F.count(F.when(F.col("cluster_id") != 0, 1)).alias("clusters")).first()
    weight = weight_column(F.col("cluster_id"), F.col("n"), whole["n"], whole["clusters"], MixtureConfig())
    u = F.size("unmasked")
    columns = []
    for i in D:
        columns.append(Q.r6(F.get("mean", F.lit(i))).alias(f"mean{i}"))
        columns.append(Q.r6(F.get("block", F.lit(i) * u + i), 9).alias(f"variance{i}"))
    return table.where("cluster_id <> 0").select(
        F.col("cluster_id").alias("class"), "n", Q.r6(weight, 9).alias("weight"),
        *columns, Q.r6(F.col("log_root_det")).alias("log_root_det"),
    )


@query(
    "it2_e_step",
    S.with_(*LINES)
    + f"""SELECT old_class, CAST(class AS INTEGER) AS class, count(*) AS n, {S.r6('sum(nlp)', 3)} AS total,
    {S.r6('min(nlp)')} AS low, {S.r6('max(nlp)')} AS high FROM lassigned GROUP BY old_class, class""",
)
def e_step(spark, sf):
    """Full-covariance scores and best classes of all lines, summed per move between classes."""
    points, noise = Q.lineitem_prepared(spark, sf)
    moved = assign(points, Q.fitted(points, noise, MixtureConfig()), noise, MixtureConfig())
    nlp = F.col("nlp")
    return moved.groupBy("old_class", "class").agg(
        F.count("*").alias("n"), Q.r6(F.sum(nlp), 3).alias("total"), Q.r6(F.min(nlp)).alias("low"), Q.r6(F.max(nlp)).alias("high")
    )


@query("it3_cem_loop", None)
def cem_loop(spark, sf):
    """The whole loop from the given labels to convergence."""
    points = Q.embedding_points(spark, sf)
    return resume(points, points.select("point_id", "class")).classes


@query(
    "it3_cem_loop_diagonal",
    S.with_(*S.diagonal_loop(S.LOOP_STEPS)) + f"SELECT point_id, CAST(class AS INTEGER) AS class FROM labels{S.LOOP_STEPS}",
)
def cem_loop_diagonal(spark, sf):
    """The whole loop with diagonal covariances, deletions included, to convergence."""
    points = Q.embedding_points(spark, sf)
    config = replace(Q.DIAGONAL, normalise=False)
    return resume(points, points.select("point_id", "class"), config).classes


@query(
    "it4_full_step_rule",
    S.with_(*S.DELETION)
    + """SELECT changed, CASE WHEN changed > 0.05 * n_points OR changed = 0 OR raw + penalty > 0 THEN 1 ELSE 0 END AS full_step
  FROM (SELECT count(CASE WHEN old_class <> class THEN 1 END) AS changed, sum(nlp) AS raw FROM after) a, total,
  (SELECT sum(params * ln(n_points) / 2) AS penalty FROM (
     SELECT class, avg(q * (q + 1) / 2 + q + 1) AS params FROM after GROUP BY class) c, total) b""",
)
def full_step_rule(spark, sf):
    """Whether the step after the first one is a full step."""
    assigned, model, n = Q.diagonal_assignment(spark, sf)
    assigned = Q.workspace(spark, "step").save(assigned, "assigned")
    o = conclude(assigned, set(model.counts), n, Q.DIAGONAL)
    full = is_full_step(o.changed, n, 1, o.score, 0.0, Q.DIAGONAL)
    return assigned.agg(
        F.lit(o.changed).cast("long").alias("changed"), F.lit(int(full)).alias("full_step")
    )


@query(
    "it5_empty_class_removal",
    """SELECT c AS class FROM (SELECT unnest(range(0, (SELECT max(label) * 3 + 1 FROM embeddings))) AS c) r
  WHERE c = 0 OR c IN (SELECT label * 3 FROM embeddings)""",
)
def empty_class_removal(spark, sf):
    """Classes still alive: noise and every class that has points."""
    used = Q.embedding_points(spark, sf).select((F.col("class") * 3).cast("long").alias("class")).distinct()
    return used.where("class <> 0").union(spark.range(1).select(F.col("id").alias("class")))


@query(
    "it6_consider_deletion",
    S.with_(*S.DELETION)
    + f"""SELECT CAST(c.class AS INTEGER) AS deleted, s.n AS points, (SELECT count(*) FROM after WHERE after.class = c.class) AS left_over
  FROM candidate c JOIN summary s ON s.class = c.class WHERE delta < 0""",
)
def consider_deletion(spark, sf):
    from maskmix.operators.selection import apply_deletion

    assigned, model, n = Q.diagonal_assignment(spark, sf)
    assigned = Q.workspace(spark, "deletion").save(assigned, "assigned")
    o = conclude(assigned, set(model.counts), n, Q.DIAGONAL)
    gone = -1 if o.deleted is None else o.deleted
    after = apply_deletion(assigned, o.deleted)
    return after.agg(
        F.lit(gone).alias("deleted"), F.lit(o.deleted_points).cast("long").alias("points"),
        F.count(F.when(F.col("class") == gone, 1)).alias("left_over"),
    ).where("deleted >= 0")


@query("it7_try_splits", None)
def splits(spark, sf):
    """A fit from one cluster per half of the labels, with splitting switched on."""
    points = Q.embedding_points(spark, sf)
    start = points.select("point_id", F.when(F.col("class") < 5, 1).otherwise(2).alias("class"))
    config = MixtureConfig(split="seeded", split_first=2)
    return resume(points, start, config).classes


@query("it8_subset_fit", None)
def subset_fit(spark, sf):
    config = replace(MixtureConfig(), subset=2, mask_starts=12)
    return fit(Q.embedding_points(spark, sf), config).classes


@query("it9_sweep", None)
def sweep(spark, sf):
    """Start counts 6 to 8 without mask-start override; the best score wins."""
    config = replace(MixtureConfig(), mask_starts=0, min_clusters=6, max_clusters=8, use_masked_initial_conditions=True)
    result = fit(Q.embedding_points(spark, sf), config)
    return result.metrics_frame(spark).groupBy("run").agg(
        F.max("iteration").alias("last"), Q.r6(F.max_by("score", "iteration"), 4).alias("score")
    )


@query(
    "it10_start_classes",
    S.with_(S.CELLS, S.MASKS, ARRIVALS, CHOSEN_MASKS, NEAREST) + "SELECT point_id, CAST(place + 1 AS INTEGER) AS class FROM nearest",
)
def starts_from_masks(spark, sf):
    labels, _ = start_classes(Q.embedding_points(spark, sf), STARTS + 1, MixtureConfig(), seed=1)
    return labels


@query(
    "it11_cost_counters",
    "SELECT 0 AS iteration, CAST(64 * 64 AS DOUBLE) * count(*) AS d2n, CAST(64 * 64 * 64 AS DOUBLE) * count(*) AS d3n FROM embeddings",
)
def cost_counters(spark, sf):
    points = Q.embedding_points(spark, sf)
    result = resume(points, points.select("point_id", "class"), MixtureConfig(max_iter=0))
    return result.metrics_frame(spark).select("iteration", "d2n", "d3n")


@query(
    "it12_initial_state",
    "SELECT vec_id AS point_id, 0 AS class, 0 AS class2 FROM embeddings",
)
def initial_state(spark, sf):
    """Every point starts in the noise class; a start of one cluster keeps it there."""
    labels, _ = start_classes(Q.embedding_points(spark, sf), 1, MixtureConfig(), seed=1)
    return labels.withColumn("class2", F.lit(0))
