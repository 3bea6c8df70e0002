"""Aggregations: class sizes, noise statistics, moments, penalties and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import double, effective_dims, parameter_count
from maskmix.functions.kernels import SUM_CORR, SUM_W
from maskmix.operators.dimensions import dimension_table
from maskmix.operators.masks import distinct_masks, with_mask
from maskmix.operators.moments import m_step, moment_cells, weight_column
from maskmix.operators.selection import (
    apply_deletion, class_penalty, class_summary, classical_penalty, conclude,
)
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.projections import CLUSTER_MASK
from maskmix.queries.registry import query


@query("ag1_class_sizes", "SELECT label AS class, count(*) AS n FROM embeddings GROUP BY label")
def class_sizes(spark, sf):
    return Q.embedding_points(spark, sf).groupBy("class").agg(F.count("*").alias("n"))


def _noise(spark, sf, column, alias):
    stats = dimension_table(Q.embedding_points(spark, sf))
    return stats.select("dim", Q.r6(F.col(column)).alias(alias))


@query("ag2_noise_mean", S.with_(S.CELLS, S.NOISE) + f"SELECT dim, {S.r6('nu')} AS nu FROM noise")
def noise_mean(spark, sf):
    return _noise(spark, sf, "noise_mean", "nu")


@query("ag3_noise_variance", S.with_(S.CELLS, S.NOISE) + f"SELECT dim, {S.r6('sigma2', 9)} AS sigma2 FROM noise")
def noise_variance(spark, sf):
    stats = dimension_table(Q.embedding_points(spark, sf))
    return stats.select("dim", Q.r6(F.col("noise_variance"), 9).alias("sigma2"))


@query("ag4_masked_count", S.with_(S.CELLS, S.NOISE) + "SELECT dim, n_masked FROM noise")
def masked_count(spark, sf):
    return dimension_table(Q.embedding_points(spark, sf)).select("dim", "n_masked")


@query(
    "ag5_mixing_weights",
    S.with_(S.WEIGHTS) + f"SELECT class, CAST(n AS BIGINT) AS n, {S.r6('exp(log_weight)', 9)} AS weight FROM weights",
)
def mixing_weight(spark, sf):
    sizes = class_sizes(spark, sf)
    whole = sizes.agg(F.sum("n").alias("n"), F.count(F.when(F.col("class") != 0, 1)).alias("clusters")).first()
    weight = weight_column(F.col("class"), F.col("n"), whole["n"], whole["clusters"], MixtureConfig())
    return sizes.select("class", "n", Q.r6(weight, 9).alias("weight"))


def _cells(spark, sf, stat: int) -> tuple[DataFrame, list[float]]:
    points, noise = Q.embedding_prepared(spark, sf)
    return moment_cells(points, noise).where(F.col("stat") == stat), noise


@query("ag6_cluster_mean", S.with_(*S.PREPARED) + f"SELECT class, dim, {S.r6('avg(y)')} AS mean FROM expected GROUP BY class, dim")
def cluster_mean(spark, sf):
    points, noise = Q.embedding_prepared(spark, sf)
    model = m_step(points, noise, MixtureConfig())
    return model.select(F.col("cluster_id").alias("class"), F.posexplode("mean").alias("dim", "mean")).select(
        "class", "dim", Q.r6(F.col("mean")).alias("mean")
    )


@query(
    "ag7_cluster_mask",
    S.with_(S.CELLS, CLUSTER_MASK) + f"SELECT class, dim, {S.r6('mass')} AS mass, unmasked FROM cluster_mask",
)
def cluster_mask(spark, sf):
    cells, _ = _cells(spark, sf, SUM_W)
    unmasked = F.when(F.col("v") >= MixtureConfig().points_for_cluster_mask, 1).otherwise(0)
    return cells.select("class", F.col("i").alias("dim"), Q.r6(F.col("v")).alias("mass"), unmasked.alias("unmasked"))


# Covariance of the cluster-unmasked block; sum of products, corrections, prior and scale.
COVARIANCE = """pairs AS (
  SELECT a.class, a.dim AS i, b.dim AS j, count(*) AS n, sum(a.r * b.r) AS product
  FROM residual a JOIN residual b ON a.point_id = b.point_id AND a.dim <= b.dim GROUP BY a.class, a.dim, b.dim)"""
RESIDUAL = """residual AS (
  SELECT point_id, e.class, e.dim, y - avg(y) OVER (PARTITION BY e.class, e.dim) AS r
  FROM expected e JOIN cluster_mask m ON m.class = e.class AND m.dim = e.dim WHERE unmasked = 1 AND e.class <> 0)"""
CORRECTION = "correction AS (SELECT class, dim, sum(corr) AS total FROM expected GROUP BY class, dim)"


def _block(spark, sf) -> DataFrame:
    points, noise = Q.embedding_prepared(spark, sf)
    model = m_step(points, noise, MixtureConfig()).where("cluster_id <> 0")
    size = F.size("unmasked")
    rows = model.select("cluster_id", "n", "unmasked", size.alias("u"), F.posexplode("block").alias("place", "v"))
    return rows.select(
        F.col("cluster_id").alias("class"),
        "n",
        F.get("unmasked", F.floor(F.col("place") / F.col("u")).cast("int")).alias("i"),
        F.get("unmasked", F.col("place") % F.col("u")).alias("j"),
        "v",
    ).where("i <= j")


@query(
    "ag8_covariance_block",
    S.with_(*S.PREPARED, CLUSTER_MASK, RESIDUAL, COVARIANCE)
    + f"SELECT class, i, j, {S.r6('product / n', 9)} AS covariance FROM pairs WHERE i < j",
)
def covariance_block(spark, sf):
    """Off-diagonal entries between dimensions the cluster leaves unmasked."""
    return _block(spark, sf).where("i < j").select("class", "i", "j", Q.r6(F.col("v"), 9).alias("covariance"))


@query("ag9_correction_sum", S.with_(*S.PREPARED, CORRECTION) + f"SELECT class, dim, {S.r6('total')} AS total FROM correction")
def correction_sum(spark, sf):
    cells, _ = _cells(spark, sf, SUM_CORR)
    return cells.select("class", F.col("i").alias("dim"), Q.r6(F.col("v")).alias("total"))


@query(
    "ag10_prior_on_diagonal",
    S.with_(*S.PREPARED, CLUSTER_MASK, CORRECTION)
    + f"""SELECT c.class, c.dim, {S.r6('total + 2 * sigma2')} AS diagonal FROM correction c
  JOIN noise n ON n.dim = c.dim JOIN cluster_mask m ON m.class = c.class AND m.dim = c.dim WHERE c.class <> 0""",
)
def prior_on_diagonal(spark, sf):
    """Unscaled diagonal of correction and prior, with a prior weight of two points."""
    points, noise = Q.embedding_prepared(spark, sf)
    prior = 2.0
    model = m_step(points, noise, MixtureConfig(prior_point=prior)).where("cluster_id <> 0")
    rows = model.select(F.col("cluster_id").alias("class"), "n", F.posexplode("variance").alias("dim", "v"))
    return rows.select("class", "dim", Q.r6(F.col("v") * (F.col("n") + prior - 1)).alias("diagonal"))


@query(
    "ag11_covariance_scale",
    S.with_(*S.PREPARED, CLUSTER_MASK, RESIDUAL, COVARIANCE, CORRECTION)
    + f"""SELECT p.class, i AS dim, {S.r6('(product + total + sigma2) / n', 9)} AS variance FROM pairs p
  JOIN correction c ON c.class = p.class AND c.dim = i JOIN noise s ON s.dim = i WHERE i = j""",
)
def covariance_scale(spark, sf):
    """Block diagonal after products, corrections, prior and scaling."""
    return _block(spark, sf).where("i = j").select("class", F.col("i").alias("dim"), Q.r6(F.col("v"), 9).alias("variance"))


PENALTY = """penalty AS (
  SELECT class, count(*) AS n, avg(q * (q + 1) / 2 + q + 1) AS params,
         avg(q * (q + 1) / 2 + q + 1) * ln(max(n_points)) / 2 AS penalty FROM dims, total GROUP BY class)"""


@query(
    "ag12_class_penalty",
    S.with_(S.CELLS, S.DIMS, S.POINTS, PENALTY) + f"SELECT class, n, {S.r6('params')} AS params, {S.r6('penalty')} AS penalty FROM penalty",
)
def penalty_by_class(spark, sf):
    points = Q.embedding_points(spark, sf)
    n = points.count()
    params = parameter_count(effective_dims(F.col("w")))
    rows = points.groupBy("class").agg(F.count("*").alias("n"), F.avg(params).alias("params"))
    penalty = F.col("params") * double(class_penalty(1.0, n, MixtureConfig()))
    return rows.select("class", "n", Q.r6(F.col("params")).alias("params"), Q.r6(penalty).alias("penalty"))


@query(
    "ag13_classical_penalty",
    f"""SELECT alive, {S.r6('params + params * ln(n) / 2')} AS penalty FROM (
  SELECT count(DISTINCT label) AS alive, count(*) AS n,
         (max(len(embedding)) * (max(len(embedding)) + 1) / 2 + max(len(embedding)) + 1) * (count(DISTINCT label) - 1) AS params
  FROM embeddings) t""",
)
def unmasked_penalty(spark, sf):
    """Penalty of the unmasked mixture with both criteria at weight one."""
    row = Q.embedding_points(spark, sf).agg(
        F.countDistinct("class").alias("alive"), F.count("*").alias("n"), F.max(F.size("x")).alias("d")
    )
    first = row.first()
    value = classical_penalty(first["d"], first["alive"], first["n"], MixtureConfig(penalty_k=1.0))
    return row.select("alive", Q.r6(double(value)).alias("penalty"))


@query("ag14_deletion_loss", S.with_(*S.STEP, S.SUMMARY) + f"SELECT class, {S.r6('loss', 4)} AS loss FROM summary")
def deletion_loss(spark, sf):
    assigned, _, _ = Q.diagonal_assignment(spark, sf)
    return class_summary(assigned).select("class", Q.r6(F.col("loss"), 4).alias("loss"))


@query(
    "ag15_total_score",
    S.with_(*S.DELETION)
    + f"""SELECT {S.r6('raw', 4)} AS raw, {S.r6('penalty', 4)} AS penalty, {S.r6('raw + penalty', 4)} AS score FROM
  (SELECT sum(nlp) AS raw FROM after) a,
  (SELECT sum(params * ln(n_points) / 2) AS penalty FROM (
     SELECT class, avg(q * (q + 1) / 2 + q + 1) AS params FROM after GROUP BY class) c, total) b""",
)
def total_score(spark, sf):
    """Score of one iteration after the deletion it asks for."""
    assigned, model, n = Q.diagonal_assignment(spark, sf)
    assigned = Q.workspace(spark, "score").save(assigned, "assigned")
    o = conclude(assigned, set(model.counts), n, Q.DIAGONAL)
    after = apply_deletion(assigned, o.deleted)
    raw = after.agg(F.sum("nlp").alias("raw"))
    return raw.select(
        Q.r6(F.col("raw"), 4).alias("raw"), Q.r6(double(o.penalty), 4).alias("penalty"),
        Q.r6(F.col("raw") + double(o.penalty), 4).alias("score"),
    )


@query("ag16_class_subscore", S.with_(*S.STEP, S.SUMMARY) + f"SELECT class, {S.r6('nlp', 4)} AS subscore FROM summary")
def class_subscore(spark, sf):
    assigned, _, _ = Q.diagonal_assignment(spark, sf)
    return class_summary(assigned).select("class", Q.r6(F.col("nlp"), 4).alias("subscore"))


@query(
    "ag17_changed_count",
    S.with_(*S.DELETION) + "SELECT count(CASE WHEN old_class <> class THEN 1 END) AS changed FROM after",
)
def changed_count(spark, sf):
    assigned, model, n = Q.diagonal_assignment(spark, sf)
    assigned = Q.workspace(spark, "changed").save(assigned, "assigned")
    after = apply_deletion(assigned, conclude(assigned, set(model.counts), n, Q.DIAGONAL).deleted)
    return after.agg(F.count(F.when(F.col("old_class") != F.col("class"), 1)).alias("changed"))


@query("ag18_distinct_masks", S.with_(S.CELLS, S.MASKS) + "SELECT count(DISTINCT mask) AS n_masks FROM masks")
def distinct_mask_count(spark, sf):
    return distinct_masks(with_mask(Q.embedding_points(spark, sf))).agg(F.count("*").alias("n_masks"))


@query(
    "ag19_reductions",
    f"""SELECT {S.r6('sum(1 / (0.5 * (event_id + 1)))')} AS total, {S.r6('sum(abs(value - 50))', 4)} AS absolute,
    min(value) AS low, max(value) AS high FROM events""",
)
def reductions(spark, sf):
    events = Q.table(spark, sf, "events")
    return events.agg(
        Q.r6(F.sum(1 / (F.lit(0.5) * (F.col("event_id") + 1)))).alias("total"),
        Q.r6(F.sum(F.abs(F.col("value") - 50)), 4).alias("absolute"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


@query("ag20_best_of_runs", None)
def best_of_runs(spark, sf):
    """The lower score of two whole fits; starts differ by seed."""
    from dataclasses import replace

    from maskmix.plans.fit import fit

    config = replace(MixtureConfig(), mask_starts=12, n_starts=2)
    result = fit(Q.embedding_points(spark, sf), config)
    runs = result.metrics_frame(spark).groupBy("run").agg(F.max_by("score", "iteration").alias("score"))
    best = runs.agg(F.min_by(F.struct("run", "score"), F.struct("score", "run")).alias("best"))
    return best.select("best.run", Q.r6(F.col("best.score"), 4).alias("score"))
