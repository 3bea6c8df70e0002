"""Projections, filters and predicates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.functions import arrays as A
from maskmix.operators.dimensions import dimension_model, explode_dims, mask_expectation, normalise
from maskmix.operators.moments import m_step
from maskmix.operators.scoring import assign, overlaps, score_matrix
from maskmix.plans.fit import choose_subset
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.registry import query
from maskmix.sources.rows import join_small
from maskmix.sources.text import select_features

BITS = "1011" * 12 + "0110"

CLUSTER_MASK = """cluster_mask AS (
  SELECT class, dim, sum(w) AS mass, CASE WHEN sum(w) >= 10 THEN 1 ELSE 0 END AS unmasked FROM cells GROUP BY class, dim)"""


@query("prj1_drop_last_features", S.with_(S.CELLS) + f"SELECT point_id, dim, {S.r6('x')} AS x FROM cells WHERE dim < 60")
def drop_last_features(spark, sf):
    kept = select_features(F.col("x"), MixtureConfig(drop_last_n_features=4))
    cells = explode_dims(Q.embedding_points(spark, sf).select("point_id", kept.alias("x")), "x")
    return cells.select("point_id", "dim", Q.r6(F.col("x")).alias("x"))


@query(
    "prj2_select_by_bits",
    S.with_(S.CELLS)
    + f"""SELECT point_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY dim) - 1 AS INTEGER) AS dim, {S.r6('x')} AS x
  FROM cells WHERE substr('{BITS}', dim + 1, 1) = '1'""",
)
def select_by_bits(spark, sf):
    kept = select_features(F.col("x"), MixtureConfig(use_features=BITS))
    cells = explode_dims(Q.embedding_points(spark, sf).select("point_id", kept.alias("x")), "x")
    return cells.select("point_id", "dim", Q.r6(F.col("x")).alias("x"))


@query(
    "prj3_min_max_normalise",
    S.with_(S.CELLS)
    + f"""SELECT point_id, dim, {S.r6('(x - min(x) OVER d) / (max(x) OVER d - min(x) OVER d)')} AS x
  FROM cells WINDOW d AS (PARTITION BY dim)""",
)
def min_max_normalise(spark, sf):
    points = Q.embedding_points(spark, sf)
    scaled = normalise(points, dimension_model(points)).select("point_id", "x")
    return explode_dims(scaled, "x").select("point_id", "dim", Q.r6(F.col("x")).alias("x"))


@query(
    "prj4_unmasked_dims",
    S.with_(S.CELLS)
    + """SELECT point_id, coalesce(string_agg(CASE WHEN w = 1 THEN CAST(dim AS VARCHAR) END, ',' ORDER BY dim), '') AS dims
  FROM cells GROUP BY point_id""",
)
def unmasked_dims(spark, sf):
    dims = A.unmasked_dims(A.binary_mask(F.col("w")))
    text = F.array_join(F.transform(dims, lambda i: i.cast("string")), ",")
    return Q.embedding_points(spark, sf).select("point_id", text.alias("dims"))


@query("prj5_effective_dims", S.with_(S.CELLS, S.DIMS) + f"SELECT point_id, {S.r6('q')} AS q FROM dims")
def effective_dims(spark, sf):
    return Q.embedding_points(spark, sf).select("point_id", Q.r6(A.effective_dims(F.col("w"))).alias("q"))


@query("prj6_masked_expectation", S.with_(*S.PREPARED) + f"SELECT point_id, dim, {S.r6('y')} AS y FROM expected")
def masked_expectation(spark, sf):
    points = Q.embedding_expected(spark, sf)
    return explode_dims(points.select("point_id", "y"), "y").select("point_id", "dim", Q.r6(F.col("y")).alias("y"))


@query("prj7_correction_term", S.with_(*S.PREPARED) + f"SELECT point_id, dim, {S.r6('corr')} AS corr FROM expected")
def correction_term(spark, sf):
    points = Q.embedding_expected(spark, sf)
    cells = explode_dims(points.select("point_id", "corr"), "corr")
    return cells.select("point_id", "dim", Q.r6(F.col("corr")).alias("corr"))


@query(
    "prj8_residual_to_own_mean",
    S.with_(*S.PREPARED)
    + f"SELECT point_id, dim, {S.r6('y - avg(y) OVER (PARTITION BY class, dim)')} AS residual FROM expected",
)
def residual_to_own_mean(spark, sf):
    points, noise = Q.embedding_prepared(spark, sf)
    means = m_step(points, noise, MixtureConfig()).select(F.col("cluster_id").alias("class"), "mean")
    joined = join_small(mask_expectation(points, noise).select("point_id", "class", "y"), means, "class")
    cells = joined.select("point_id", F.zip_with("y", "mean", lambda y, m: y - m).alias("residual"))
    return explode_dims(cells, "residual").select("point_id", "dim", Q.r6(F.col("residual")).alias("residual"))


SUBSET = f"""chosen AS (
  SELECT n AS point_id FROM (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n, (SELECT count(*) FROM embeddings) // 4 * 4 AS whole FROM embeddings) r
  WHERE n < whole AND n = n // 4 * 4 + {A.portable_hash_sql('n // 4', 1)} % 4)"""


@query(
    "prj9_row_subset",
    S.with_(S.CELLS, S.DIMS, SUBSET)
    + f"SELECT d.point_id, class, {S.r6('q')} AS q FROM dims d WHERE d.point_id IN (SELECT point_id FROM chosen)",
)
def row_subset(spark, sf):
    """A subset keeps the noise model and corrections of all points."""
    points = Q.embedding_expected(spark, sf)
    ids = choose_subset(points, 4, 1, Q.workspace(spark, "subset"))
    return points.join(ids, "point_id", "left_semi").select("point_id", "class", Q.r6(F.col("q")).alias("q"))


@query("prj10_class_members", "SELECT vec_id AS point_id, label AS class FROM embeddings WHERE label = 3")
def class_members(spark, sf):
    return Q.embedding_points(spark, sf).where("class = 3").select("point_id", "class")


@query(
    "prj11_gather_unmasked",
    S.with_(*S.PREPARED, CLUSTER_MASK)
    + f"""SELECT point_id, e.dim, {S.r6('y')} AS y FROM expected e
  JOIN cluster_mask m ON m.class = e.class AND m.dim = e.dim WHERE unmasked = 1 AND e.class <> 0""",
)
def gather_unmasked(spark, sf):
    """The columns of each point that its own cluster leaves unmasked."""
    points, noise = Q.embedding_prepared(spark, sf)
    model = m_step(points, noise, MixtureConfig()).select(F.col("cluster_id").alias("class"), "unmasked")
    expected = mask_expectation(points.where("class <> 0"), noise)
    joined = join_small(expected.select("point_id", "class", "y"), model, "class")
    gathered = joined.select("point_id", "unmasked", F.transform("unmasked", lambda i: F.get("y", i)).alias("y"))
    return explode_dims(gathered, "unmasked", "y").select(
        "point_id", F.col("unmasked").alias("dim"), Q.r6(F.col("y")).alias("y")
    )


THRESHOLD = repr(math.log(1000.0))


@query(
    "prj12_quick_step_skips",
    S.with_(*S.STEP)
    + f"""SELECT s.point_id, CAST(s.cluster_id AS INTEGER) AS cluster_id,
    CASE WHEN a.class = a.old_class AND s.nlp - a.nlp > CAST({THRESHOLD} AS DOUBLE) THEN 1 ELSE 0 END AS skipped
  FROM scores s JOIN assigned a ON a.point_id = s.point_id WHERE s.cluster_id <> 0""",
)
def quick_step_skips(spark, sf):
    """Pairs a quick step would leave alone: class kept and the cluster far behind the own one."""
    points, noise = Q.embedding_prepared(spark, sf)
    model = Q.fitted(points, noise, Q.DIAGONAL)
    scores = score_matrix(points, model, noise, Q.DIAGONAL).where("cluster_id <> 0").select("point_id", "cluster_id", F.col("nlp").alias("score"))
    own = assign(points, model, noise, Q.DIAGONAL).select("point_id", "old_class", "class", "nlp")
    skip = (F.col("class") == F.col("old_class")) & (F.col("score") - F.col("nlp") > Q.DIAGONAL.dist_thresh)
    return scores.join(own, "point_id").select(
        "point_id", "cluster_id", F.when(skip, 1).otherwise(0).alias("skipped")
    )


@query(
    "prj13_mask_overlap",
    S.with_(S.CELLS, CLUSTER_MASK)
    + f"""SELECT point_id, m.class AS cluster_id, {S.r6('sum(w * unmasked)')} AS overlap,
    CASE WHEN sum(w * unmasked) >= 20 THEN 1 ELSE 0 END AS kept
  FROM cells c JOIN cluster_mask m ON m.dim = c.dim WHERE m.class <> 0 GROUP BY point_id, m.class""",
)
def mask_overlap(spark, sf):
    """Soft mask mass of a point on the unmasked dimensions of every cluster, with its cut at 20."""
    points, noise = Q.embedding_prepared(spark, sf)
    rows = overlaps(points, Q.fitted(points, noise, MixtureConfig()), noise.dims)
    kept = F.when(F.col("overlap") >= 20, 1).otherwise(0)
    return rows.select("point_id", "cluster_id", Q.r6(F.col("overlap")).alias("overlap"), kept.alias("kept"))


@query("prj14_reciprocal", f"SELECT event_id AS i, {S.r6('1 / (0.5 * (event_id + 1))', 9)} AS v FROM events")
def reciprocal(spark, sf):
    return Q.table(spark, sf, "events").select(
        F.col("event_id").alias("i"), Q.r6(1 / (F.lit(0.5) * (F.col("event_id") + 1)), 9).alias("v")
    )
