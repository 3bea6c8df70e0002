"""What the program does as joins: positional matches, model lookups, nearest masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import double, portable_hash_sql, portable_uniform_sql
from maskmix.operators.dimensions import dimension_table, expectation, explode_dims, mask_expectation
from maskmix.operators.masks import distinct_masks, nearest_mask, sample_masks, with_mask
from maskmix.operators.moments import m_step
from maskmix.operators.scoring import score_matrix
from maskmix.plans.fit import choose_subset
from maskmix.plans.split import seed_halves
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.projections import SUBSET
from maskmix.queries.registry import query
from maskmix.sources.rows import join_small


@query("jn1_features_with_masks", S.with_(S.CELLS) + f"SELECT point_id, {S.r6('sum(w * x)')} AS weighted FROM cells GROUP BY point_id")
def features_with_masks(spark, sf):
    points = Q.embedding_points(spark, sf)
    joined = points.select("point_id", "x").join(points.select("point_id", "w"), "point_id")
    weighted = F.aggregate(F.zip_with("x", "w", lambda x, w: x * w), double(0), lambda s, v: s + v)
    return joined.select("point_id", Q.r6(weighted).alias("weighted"))


@query(
    "jn2_points_with_noise",
    S.with_(*S.PREPARED) + f"SELECT class, dim, {S.r6('sum(y)')} AS total FROM expected GROUP BY class, dim",
)
def points_with_noise(spark, sf):
    """Long form: the statistics hold one row per dimension and are broadcast."""
    points = Q.embedding_points(spark, sf)
    noise = dimension_table(points).select("dim", "noise_mean")
    cells = join_small(explode_dims(points, "x", "w"), noise, "dim")
    y = expectation(F.col("x"), F.col("w"), F.col("noise_mean"))
    return cells.groupBy("class", "dim").agg(Q.r6(F.sum(y)).alias("total"))


@query(
    "jn3_points_with_own_cluster",
    S.with_(*S.PREPARED)
    + f"""SELECT point_id, {S.r6('sum((y - mean) * (y - mean))')} AS squared_distance
  FROM (SELECT point_id, y, avg(y) OVER (PARTITION BY class, dim) AS mean FROM expected) e GROUP BY point_id""",
)
def points_with_own_cluster(spark, sf):
    points, noise = Q.embedding_prepared(spark, sf)
    model = m_step(points, noise, MixtureConfig()).select(F.col("cluster_id").alias("class"), "mean")
    joined = join_small(mask_expectation(points, noise).select("point_id", "class", "y"), model, "class")
    squares = F.zip_with("y", "mean", lambda y, m: (y - m) * (y - m))
    return joined.select("point_id", Q.r6(F.aggregate(squares, double(0), lambda s, v: s + v)).alias("squared_distance"))


@query(
    "jn4_points_by_clusters",
    S.with_(*S.PREPARED, S.WEIGHTS, S.DIAGONAL, S.SCORES)
    + f"""SELECT point_id, CAST(cluster_id AS INTEGER) AS cluster_id, {S.r6('mahalanobis')} AS mahalanobis,
    {S.r6('variance_term')} AS variance_term, {S.r6('nlp')} AS nlp FROM scores""",
)
def points_by_clusters(spark, sf):
    points, noise = Q.embedding_prepared(spark, sf)
    scores = score_matrix(points, Q.fitted(points, noise, Q.DIAGONAL), noise, Q.DIAGONAL)
    return scores.select(
        "point_id", "cluster_id", *[Q.r6(F.col(c)).alias(c) for c in ("mahalanobis", "variance_term", "nlp")]
    )


#: Start masks of a fit with the default 500 start classes.
STARTS = 499
ARRIVALS = f"""arrivals AS (
  SELECT mask, n, first_point, -ln({portable_uniform_sql('first_point', 1)}) / n AS arrival FROM (
    SELECT mask, count(*) AS n, min(point_id) AS first_point FROM masks GROUP BY mask) d)"""
CHOSEN_MASKS = f"""chosen_masks AS (
  SELECT mask, row_number() OVER (ORDER BY arrival, first_point) - 1 AS place
  FROM (SELECT * FROM arrivals ORDER BY arrival, first_point LIMIT {STARTS}) a)"""
NEAREST = """nearest AS (
  SELECT point_id, place, distance FROM (
    SELECT point_id, place, distance, row_number() OVER (PARTITION BY point_id ORDER BY distance, place) AS best FROM (
      SELECT m.point_id, c.place, CAST(hamming(m.mask, c.mask) AS INTEGER) AS distance FROM masks m, chosen_masks c) p) q
  WHERE best = 1)"""


def chosen_masks(spark, sf):
    masked = with_mask(Q.embedding_points(spark, sf))
    chosen = sample_masks(distinct_masks(masked), STARTS, 1).select("mask").collect()
    return masked, [list(r["mask"]) for r in chosen]


@query(
    "jn5_nearest_start_mask",
    S.with_(S.CELLS, S.MASKS, ARRIVALS, CHOSEN_MASKS, NEAREST)
    + "SELECT point_id, CAST(place + 1 AS INTEGER) AS class, distance FROM nearest",
)
def nearest_start_mask(spark, sf):
    masked, chosen = chosen_masks(spark, sf)
    return nearest_mask(masked, chosen)


@query(
    "jn6_points_with_mask_id",
    S.with_(S.CELLS, S.MASKS) + "SELECT point_id, dense_rank() OVER (ORDER BY mask) - 1 AS mask_id FROM masks",
)
def points_with_mask_id(spark, sf):
    from maskmix.queries.windows import mask_index

    masked = with_mask(Q.embedding_points(spark, sf))
    return mask_index(masked, Q.workspace(spark, "index")).select("point_id", F.col("mask_index").alias("mask_id"))


@query(
    "jn7_subset_membership",
    S.with_(SUBSET) + "SELECT vec_id AS point_id, label AS class FROM embeddings WHERE vec_id IN (SELECT point_id FROM chosen)",
)
def subset_membership(spark, sf):
    points = Q.embedding_points(spark, sf).select("point_id", "class")
    return points.join(choose_subset(points, 4, 1, Q.workspace(spark, "subset")), "point_id", "left_semi")


@query(
    "jn8_sub_labels_to_parent",
    f"""SELECT vec_id AS point_id, CASE WHEN label = 3 AND {portable_hash_sql('vec_id', 1)} % 2 = 1 THEN 10 ELSE label END AS class FROM embeddings""",
)
def sub_labels_to_parent(spark, sf):
    """Cluster 3 is halved on its own; the second half comes back as the first free class."""
    points = Q.embedding_points(spark, sf).select("point_id", "class")
    halves = seed_halves(points.where("class = 3"), 1).select("point_id", "half")
    moved = F.when(F.col("half") == 7, 10).otherwise(F.col("class")).cast("int")
    return points.join(halves, "point_id", "left").select("point_id", moved.alias("class"))


@query(
    "jn9_score_lookup",
    S.with_(*S.STEP)
    + f"SELECT point_id, {S.r6('nlp')} AS own_score, {S.r6('nlp2')} AS second_score FROM assigned",
)
def score_lookup(spark, sf):
    """Both scores leave the C-step as columns, so nothing is looked up again."""
    assigned, _, _ = Q.diagonal_assignment(spark, sf)
    return assigned.select("point_id", Q.r6(F.col("nlp")).alias("own_score"), Q.r6(F.col("nlp2")).alias("second_score"))


@query(
    "jn10_dimension_pairs",
    S.with_(*S.PREPARED)
    + f"""SELECT a.class, a.dim AS i, b.dim AS j, {S.r6('sum(a.y * b.y)')} AS product
  FROM (SELECT class, point_id, e.dim, y - nu AS y FROM expected e JOIN noise n ON n.dim = e.dim) a
  JOIN (SELECT point_id, e.dim, y - nu AS y FROM expected e JOIN noise n ON n.dim = e.dim) b
  ON a.point_id = b.point_id AND a.dim <= b.dim WHERE a.class <> 0 GROUP BY a.class, a.dim, b.dim""",
)
def dimension_pairs(spark, sf):
    """Products of all dimension pairs by class; tasks add up matrices, no pair rows per point."""
    from maskmix.functions.kernels import GRAM
    from maskmix.operators.moments import moment_cells

    points, noise = Q.embedding_prepared(spark, sf)
    cells = moment_cells(points, noise).where(F.col("stat") == GRAM)
    return cells.select("class", "i", "j", Q.r6(F.col("v")).alias("product"))
