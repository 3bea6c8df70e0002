"""Scoring a stream of points with a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.operators.dimensions import DimensionModel
from maskmix.operators.scoring import MixtureModel, assign


def score_stream(stream: DataFrame, model: MixtureModel, noise: DimensionModel, config: MixtureConfig) -> DataFrame:
    """Class of every arriving ``(point_id, x, w)``; stateless, so any trigger and restart works."""
    points = stream.select("point_id", "x", "w").withColumn("class", F.lit(0))
    return assign(points, model, noise, config).drop("old_class")
