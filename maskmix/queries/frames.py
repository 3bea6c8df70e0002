"""Inputs shared by the queries: points, masks and models taken from the given tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskmix.config import MixtureConfig
from maskmix.operators.dimensions import DimensionModel, dimension_model, explode_dims, mask_expectation
from maskmix.operators.moments import m_step
from maskmix.operators.scoring import MixtureModel, assign, read_model
from maskmix.sources.rows import spread
from maskmix.workspace import Workspace

# Every dimension counts as masked, so covariances are diagonal and SQL can repeat the scores.
DIAGONAL = MixtureConfig(points_for_cluster_mask=math.inf)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def soft_mask(x: Column, slope: float) -> Column:
    return F.transform(x, lambda v: F.least(F.lit(1.0), F.lit(slope) * F.abs(v)))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point_id, class, x, w``: 64 features, start class and a soft mask that grows with |x|."""
    e, _ = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "vec_id")
    return e.select(
        F.col("vec_id").alias("point_id"),
        F.col("label").alias("class"),
        F.col("embedding").cast("array<double>").alias("x"),
    ).withColumn("w", soft_mask(F.col("x"), 5.0))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_dims(embedding_points(spark, sf_dir), "x", "w")


def embedding_prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DimensionModel]:
    """Points with their noise model on the raw feature scale."""
    points = embedding_points(spark, sf_dir)
    return points, dimension_model(points)


def embedding_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with expectations ``y`` and corrections ``corr``."""
    return mask_expectation(*embedding_prepared(spark, sf_dir))


LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_ranges(spark: SparkSession, sf_dir: str):
    """Least and largest value of each feature."""
    return table(spark, sf_dir, "lineitem").agg(
        *[F.min(c).alias(f"low_{c}") for c in LINEITEM_FEATURES],
        *[F.max(c).alias(f"high_{c}") for c in LINEITEM_FEATURES],
    ).first()


def lineitem_points(lines: DataFrame, ranges) -> DataFrame:
    """Four scaled features of lines; class is the line number from zero, mask 2x up to one."""
    n = len(LINEITEM_FEATURES)
    scaled = [
        (F.col(c) - F.lit(low)) / F.lit(high - low)
        for c, low, high in zip(LINEITEM_FEATURES, ranges[:n], ranges[n:])
    ]
    return lines.select(
        (F.col("l_linenumber") - 1).alias("class"),
        F.array(*scaled).alias("x"),
        F.array(*[F.least(F.lit(1.0), 2 * F.abs(v)) for v in scaled]).alias("w"),
    )


def lineitem_prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DimensionModel]:
    """The points of all lines with an id, and their noise model."""
    lines, _ = spread(table(spark, sf_dir, "lineitem").select("l_linenumber", *LINEITEM_FEATURES))
    points = lineitem_points(lines, lineitem_ranges(spark, sf_dir))
    points = points.select(F.monotonically_increasing_id().alias("point_id"), "class", "x", "w")
    return points, dimension_model(points)


def fitted(points: DataFrame, noise: DimensionModel, config: MixtureConfig) -> MixtureModel:
    """One M-step on the given classes."""
    return read_model(m_step(points, noise, config), noise.dims, config)


def diagonal_assignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, MixtureModel, int]:
    """One M-, E- and C-step on the embeddings with diagonal covariances."""
    points, noise = embedding_prepared(spark, sf_dir)
    model = fitted(points, noise, DIAGONAL)
    return assign(points, model, noise, DIAGONAL), model, sum(model.counts.values())


def workspace(spark: SparkSession, name: str) -> Workspace:
    return Workspace(spark, name)
