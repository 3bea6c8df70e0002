"""Scalar, array and linear-algebra functions on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import hamming, portable_hash_sql, random_integer
from maskmix.operators.moments import m_step, mixing_weights
from maskmix.operators.scoring import score_sums
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.joins import chosen_masks, ARRIVALS, CHOSEN_MASKS
from maskmix.queries.registry import query

LINES = S.lineitem(Q.LINEITEM_FEATURES)
D = range(len(Q.LINEITEM_FEATURES))


@query("fn1_log", f"SELECT event_id, CASE WHEN value > 0 THEN {S.r6('ln(greatest(value, 1e-300))')} END AS v FROM events")
def log(spark, sf):
    """Null where the logarithm is not defined."""
    return Q.table(spark, sf, "events").select("event_id", Q.r6(F.when(F.col("value") > 0, F.ln("value"))).alias("v"))


@query("fn2_sqrt", f"SELECT event_id, CASE WHEN value >= 0 THEN {S.r6('sqrt(abs(value))')} END AS v FROM events")
def square_root(spark, sf):
    """Null where the root is not defined."""
    return Q.table(spark, sf, "events").select("event_id", Q.r6(F.when(F.col("value") >= 0, F.sqrt("value"))).alias("v"))


@query("fn3_abs_least", f"SELECT event_id, {S.r6('abs(value - 50)')} AS a, {S.r6('least(value, 50)')} AS b FROM events")
def absolute_and_least(spark, sf):
    v = F.col("value")
    return Q.table(spark, sf, "events").select(
        "event_id", Q.r6(F.abs(v - 50)).alias("a"), Q.r6(F.least(v, F.lit(50.0))).alias("b")
    )


@query("fn4_random_integer", f"SELECT event_id, {portable_hash_sql('event_id', 7)} % 6 + 5 AS v FROM events")
def random_integers(spark, sf):
    return Q.table(spark, sf, "events").select("event_id", random_integer(F.col("event_id"), 7, 5, 10).alias("v"))


@query(
    "fn5_gaussian_constant",
    f"SELECT {S.r6('max(len(embedding)) * ln(2 * pi()) / 2')} AS v FROM embeddings",
)
def gaussian_constant(spark, sf):
    constant = F.max(F.size("x")) * F.lit(0.5 * math.log(2 * math.pi))
    return Q.embedding_points(spark, sf).agg(Q.r6(constant).alias("v"))


def _model(spark, sf):
    points, noise = Q.lineitem_prepared(spark, sf)
    return m_step(points, noise, MixtureConfig()).where("cluster_id <> 0")


def _triangle(prefix: str, transposed: bool = False) -> str:
    entries = " UNION ALL ".join(
        f"SELECT class, {i} AS i, {j} AS j, {S.r6(f'{prefix}{i}{j}')} AS v FROM model WHERE class <> 0"
        for i in D for j in D if j <= i
    )
    return S.with_(*LINES) + entries


def _root_inverse(spark, sf):
    rows = _model(spark, sf).select("cluster_id", F.size("unmasked").alias("u"), F.posexplode("root_inverse").alias("p", "v"))
    return rows.select(
        F.col("cluster_id").alias("class"),
        F.floor(F.col("p") / F.col("u")).cast("int").alias("i"),
        (F.col("p") % F.col("u")).cast("int").alias("j"),
        "v",
    ).where("j <= i")


@query(
    "fn6_cholesky",
    S.with_(*LINES)
    + " UNION ALL ".join(f"SELECT class, {i} AS i, {S.r6(f'{S.ONE} / l{i}{i}')} AS v FROM model WHERE class <> 0" for i in D),
)
def cholesky(spark, sf):
    """Inverse pivots of each class's factor; every line-item feature is unmasked."""
    return _root_inverse(spark, sf).where("i = j").select("class", "i", Q.r6(F.col("v")).alias("v"))


@query("fn7_triangular_solve", _triangle("v"))
def triangular_solve(spark, sf):
    """The factor solved against every unit vector."""
    return _root_inverse(spark, sf).select("class", "i", "j", Q.r6(F.col("v")).alias("v"))


@query("fn8_log_root_determinant", S.with_(*LINES) + f"SELECT class, {S.r6('log_root_det')} AS v FROM model WHERE class <> 0")
def log_root_determinant(spark, sf):
    return _model(spark, sf).select(F.col("cluster_id").alias("class"), Q.r6(F.col("log_root_det")).alias("v"))


@query(
    "fn9_inverse_diagonal",
    S.with_(*LINES)
    + " UNION ALL ".join(f"SELECT class, {i} AS dim, {S.r6(f'p{i}')} AS v FROM model WHERE class <> 0" for i in D),
)
def inverse_diagonal(spark, sf):
    model = _model(spark, sf).select(F.col("cluster_id").alias("class"), F.posexplode("inv_diag").alias("dim", "v"))
    return model.select("class", "dim", Q.r6(F.col("v")).alias("v"))


def _score_sums(column: str) -> str:
    return S.with_(*LINES) + (
        f"SELECT old_class AS class, CAST(cluster_id AS INTEGER) AS cluster_id, count(*) AS n, "
        f"{S.r6(f'sum({column})', 3)} AS total, {S.r6(f'min({column})')} AS low, {S.r6(f'max({column})')} AS high "
        f"FROM lscores WHERE cluster_id <> 0 GROUP BY old_class, cluster_id"
    )


def _summed(spark, sf, column):
    points, noise = Q.lineitem_prepared(spark, sf)
    sums = score_sums(points, Q.fitted(points, noise, MixtureConfig()), noise, MixtureConfig())
    return sums.select(
        "class", "cluster_id", "n", Q.r6(F.col(f"{column}_total"), 3).alias("total"),
        Q.r6(F.col(f"{column}_low")).alias("low"), Q.r6(F.col(f"{column}_high")).alias("high"),
    )


@query("fn10_mahalanobis", _score_sums("mahalanobis"))
def mahalanobis(spark, sf):
    """Full-covariance distances of every line to every class, summed per pair of classes."""
    return _summed(spark, sf, "mahalanobis")


@query("fn11_variance_term", _score_sums("variance_term"))
def variance_term(spark, sf):
    return _summed(spark, sf, "variance_term")


@query("fn12_cluster_score", _score_sums("nlp"))
def cluster_score(spark, sf):
    return _summed(spark, sf, "nlp")


@query("fn13_noise_score", S.with_(S.WEIGHTS) + f"SELECT vec_id AS point_id, {S.r6('-log_weight')} AS nlp FROM embeddings, weights WHERE class = 0")
def noise_score(spark, sf):
    """Every point has the same noise score, which the sizes of the classes decide."""
    points = Q.embedding_points(spark, sf).select("point_id", "class")
    sizes = {r["class"]: r["count"] for r in points.groupBy("class").count().collect()}  # one row per class
    weight = mixing_weights(sizes, sum(sizes.values()), Q.DIAGONAL)[0]
    return points.select("point_id", Q.r6(F.lit(-math.log(weight))).alias("nlp"))


@query(
    "fn14_mask_hamming",
    S.with_(S.CELLS, S.MASKS, ARRIVALS, CHOSEN_MASKS)
    + "SELECT point_id, CAST(hamming(m.mask, c.mask) AS INTEGER) AS distance FROM masks m, chosen_masks c WHERE place = 0",
)
def mask_hamming(spark, sf):
    """Distance of every mask to the first mask drawn."""
    masked, chosen = chosen_masks(spark, sf)
    first = F.array(*[F.lit(v) for v in chosen[0]]).cast("array<tinyint>")
    return masked.select("point_id", hamming(F.col("mask"), first).alias("distance"))


@query(
    "fn15_compare_vectors",
    S.with_(S.CELLS)
    + f"""SELECT count(*) AS n_total, count(CASE WHEN error > 0 THEN 1 END) AS n_error,
    {S.r6('avg(CASE WHEN error > 0 THEN error END)')} AS mean_error, {S.r6('max(error)')} AS max_error
  FROM (SELECT abs(x - w * x) AS error FROM cells) c""",
)
def compare_vectors(spark, sf):
    """Number, mean and largest of the differences between the features and their weighted form."""
    cells = Q.embedding_cells(spark, sf)
    error = F.abs(F.col("x") - F.col("w") * F.col("x"))
    differs = F.when(error > 0, error)
    return cells.agg(
        F.count("*").alias("n_total"), F.count(differs).alias("n_error"),
        Q.r6(F.avg(differs)).alias("mean_error"), Q.r6(F.max(error)).alias("max_error"),
    )


@query(
    "fn16_sample_covariance",
    f"""SELECT l_linenumber - 1 AS class, {S.r6('covar_samp(l_quantity, l_extendedprice)', 3)} AS quantity_price,
    {S.r6('covar_samp(l_discount, l_tax)', 9)} AS discount_tax FROM lineitem GROUP BY l_linenumber""",
)
def sample_covariance(spark, sf):
    """Covariance around the class's own mean with divisor n - 1."""
    return Q.table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("class")).agg(
        Q.r6(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("quantity_price"),
        Q.r6(F.covar_samp("l_discount", "l_tax"), 9).alias("discount_tax"),
    )


@query(
    "fn17_log_determinant_sum",
    S.with_(*S.PREPARED, S.DIAGONAL)
    + f"SELECT class, {S.r6('sum(ln(sqrt(variance)))')} AS log_root_det FROM diagonal WHERE class <> 0 GROUP BY class",
)
def log_determinant_sum(spark, sf):
    """The sum of logs, as the finished program has it, not a count of ones as in its draft."""
    points, noise = Q.embedding_prepared(spark, sf)
    model = m_step(points, noise, Q.DIAGONAL).where("cluster_id <> 0")
    return model.select(F.col("cluster_id").alias("class"), Q.r6(F.col("log_root_det")).alias("log_root_det"))
